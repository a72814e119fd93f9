"""Byte-level BPE of whole texts and of the chunks between which no token reaches.

A text is cut where no pre-token of the vocabulary's pattern can reach across:
before every single space, and around every single line feed.  Runs of white
space that are longer keep their last character for what follows, as the pattern
``\\s+(?!\\S)`` does.  Each chunk has the same ids wherever it stands, so that a
worker encodes a chunk once and then looks it up.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: Unicode's white space.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
DOUBLE = re.compile(f"[{SPACE}]{{2}}")
RUN = re.compile(f"([{SPACE}]+(?=[{SPACE}][^{SPACE}])|[{SPACE}]{{2,}}\\Z)")
ODD = re.compile(f"[{SPACE}]")
RARE = re.compile("[^\0-\u024f\u2010-\u206f]")
#: Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def chunks(text: str) -> list[str]:
    if "\0" in text:
        return [text]
    if DOUBLE.search(text):
        found: list[str] = []
        for i, part in enumerate(RUN.split(text)):
            if part:
                found += [part] if i % 2 else cut(part)
        return found
    return cut(text)


def cut(text: str) -> list[str]:
    return [x for x in text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") if x]


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes: printable Latin-1 as is, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids for one vocabulary file, as the library ``tokenizers`` gives them.

    Texts of Latin letters go through a faster implementation of the same merges,
    allowed only where the file's merges are numbered in their order (checked), the
    pre-tokenizer is the plain byte-level one and nothing normalises.  Texts with
    other letters or with a special token's string go through ``tokenizers``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.no_truncation()
        self.slow.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added, pre, model = spec["added_tokens"], spec["pre_tokenizer"] or {}, spec["model"]
        self.special = [t["content"] for t in added]
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        apart = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or ODD.search(t["content"]) for t in added)
        self.plain = apart and not spec["normalizer"] and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex")
        self.single = self.double = None
        vocab, merges = model.get("vocab"), [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
        if self.plain and model["type"] == "BPE" and all(vocab["".join(m)] == 256 + i for i, m in enumerate(merges)) and not (model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")):
            import tiktoken

            letters = byte_letters()
            ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in self.special}
            self.line = vocab["Ċ"]
            # without a run of white space the lookahead never matters, and a pattern without it is much faster
            self.double = tiktoken.Encoding("runs", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.single = tiktoken.Encoding("single", pat_str=PATTERN.replace(r"\s+(?!\S)|\s+", r"\s"), mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> list[int]:
        if self.single is None or RARE.search(text) or any(s in text for s in self.special):
            return self.slow.encode(text, add_special_tokens=False).ids
        return (self.double if DOUBLE.search(text) else self.single)(text)

    def chunks(self, text: str) -> list[str]:
        """Parts whose ids, put together, are the text's."""
        if not self.plain:
            return [text]
        if self.marks and self.marks.search(text):
            return [y for i, x in enumerate(self.marks.split(text)) if x for y in ([x] if i % 2 else chunks(x))]
        return chunks(text)

    def lengths(self, some: list[str]) -> list[int]:
        """Numbers of ids of chunks, encoded together where they are usual ones."""
        if self.single is None:
            return [len(self.ids(x)) for x in some]
        usual = [x for x in some if x != " " and not ODD.search(x, x[0] == " ")]
        text = "\n".join(usual)
        if RARE.search(text) or any(s in text for s in self.special):
            usual = [x for x in usual if not RARE.search(x) and x not in self.special]
        ends = np.flatnonzero(np.array(self.single("\n".join(usual) + "\n"), np.uint32) == self.line) if usual else []
        found = dict(zip(usual, (np.diff(ends, prepend=-1) - 1).tolist(), strict=True)) if usual else {}
        return [found[x] if x in found else len(self.ids(x)) for x in some]
