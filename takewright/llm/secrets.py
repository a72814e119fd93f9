"""Secret scans with linking of multipart credentials, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Kinds of spans in the order in which they are listed where they start together.
KINDS = ("assign", "access", "hex", "account", "blob", "endpoint")
BASE = KINDS[:3]
#: Which part of a credential a kind is: an identifier, a secret or an endpoint.
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "account": "identifier", "blob": "secret", "endpoint": "endpoint"}
SPAN = "array<struct<s:int,k:int,e:int>>"


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _assigned(names: list[str], value: str) -> str:
    return "(" + "|".join(map(either_case, names)) + r""")["']?\x20*[:=]\x20*["']?(""" + value + ")"


#: What the kinds look like.  A match of assign counts where its value has 6 characters, a blob where it has a digit and letters of both cases.
#: No group repeats, and a run that is long begins where a look-behind finds its start, so that a text costs time in proportion to its length.
PATTERNS = {
    "assign": _assigned(["password", "passwd", "secret", "token", "api_?key"], "[A-Za-z0-9+/_.=-]+"),
    "access": "AKIA[A-Z0-9]{16,}",
    "hex": "(?<![0-9a-f])[0-9a-f]{24,}",
    "account": _assigned(["username", "user", "login", "account", "client_?id", "access_?key_?id"], "[A-Za-z0-9_.@-]{3,}"),
    "blob": "(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{24,}={0,2}",
    "endpoint": r"""(?<![A-Za-z0-9+.-])[a-z][a-z0-9+.-]*+://[^\x20\x09-\x0D"'<>]+|(?<![A-Za-z0-9.-])[A-Za-z0-9-]++[.][A-Za-z0-9.-]*+(?<=[A-Za-z0-9-]):[0-9]{2,5}""",
}
#: What a text must have for a kind to be in it at all; ``low`` is the text in small letters, ``run`` says whether it has a run that could be hex or a blob.
GUARDS = {
    "assign": "(contains(t, ':') or contains(t, '=')) and (contains(low, 'passw') or contains(low, 'secret') or contains(low, 'token') or contains(low, 'api'))",
    "access": "contains(t, 'AKIA')",
    "hex": "run",
    "account": "(contains(t, ':') or contains(t, '=')) and (contains(low, 'user') or contains(low, 'login') or contains(low, 'account') or contains(low, 'client') or contains(low, 'access'))",
    "blob": "run",
    "endpoint": "contains(t, '://') or t rlike ':[0-9]{2}'",
}
RUN = "t rlike '(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{24}'"
GROUP = 512
MARK, OTHER = "\ue000", "\ue001"  # neither is in any kind's letters


def spans(kind: str) -> str:
    """SQL for the array of (start, kind, end) of a pattern's matches in the column ``t``, leftmost and non-overlapping.

    Matches are set between marks and the text is split at these.  Starts are running sums of the lengths of what lies between matches and of
    matches, taken within groups of GROUP matches and over the groups, so that a text of very many matches costs little more than its length.
    """
    pattern = PATTERNS[kind].replace("\\", "\\\\").replace("'", "\\'")
    number = KINDS.index(kind)
    keep = {"assign": f"length(regexp_extract(x, '^(?:{pattern})', 2)) >= 6", "blob": "x rlike '[0-9]' and x rlike '[A-Z]' and x rlike '[a-z]'"}.get(kind, "true")
    cut = f"split(regexp_replace(translate(t, '{MARK}', '{OTHER}'), '{pattern}', '{MARK}$0{MARK}'), '{MARK}', -1)"
    each = f"""transform(sequence(0, (size(cut) - 1) div 2), i -> transform(array(get(cut, 2 * i + 1)), x ->
        named_struct('gap', length(cut[2 * i]), 'size', coalesce(length(x), 0), 'keep', x is not null and {keep}))[0])"""
    grouped = f"transform(sequence(0, cast(floor((size(all) - 1) / {GROUP}) as int)), g -> slice(all, g * {GROUP} + 1, {GROUP}))"
    run = f"""aggregate(g, named_struct('at', base, 'out', cast(array() as {SPAN})), (acc, x) -> named_struct('at', acc.at + x.gap + x.size,
        'out', if(x.keep, array_append(acc.out, named_struct('s', acc.at + x.gap, 'k', {number}, 'e', acc.at + x.gap + x.size)), acc.out)), acc -> acc.out)"""
    sums = "transform(groups, g -> aggregate(g, 0, (t, x) -> t + x.gap + x.size))"
    bases = "transform(sums, (t, i) -> aggregate(slice(sums, 1, i), 0, (a, b) -> a + b))"
    # transform over an array of one value names that value for what follows
    named = f"""transform(array({cut}), cut -> transform(array({each}), all -> transform(array({grouped}), groups -> transform(array({sums}), sums ->
        flatten(zip_with(groups, {bases}, (g, base) -> {run}))))))[0][0][0][0]"""
    return f"if({GUARDS[kind]}, {named}, cast(array() as {SPAN}))"


def _listed(array: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({array}, x -> concat(array({names})[x.k], ':', x.s, ':', x.e)), ',')"


def parts(docs: DataFrame) -> DataFrame:
    """doc_id, key (md5 of the text, null text counting as empty), base and weak: sorted spans of the base kinds and of the others."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    rows = rows.select("doc_id", "t", F.lower("t").alias("low"), F.expr(RUN).alias("run"))
    found = {k: F.expr(spans(k)) for k in KINDS}
    base = F.array_sort(F.concat(found["assign"], found["access"], found["hex"]))
    weak = F.concat(found["account"], found["blob"], found["endpoint"])
    return rows.select("doc_id", F.md5("t").alias("key"), base.alias("base"), weak.alias("weak"))


def linked(found: DataFrame, scope: int = 200) -> DataFrame:
    """(doc_id, key, more, links): the weak spans that complementary parts near them confirm, and which parts belong together.

    An identifier and a secret belong together, and so do a secret and an endpoint, where the later one starts at most ``scope`` code points
    after the earlier one's end.  A weak identifier needs a secret, a weak secret an identifier or an endpoint, an endpoint an
    identifier and a secret.  The join is one of intervals: a part lies in all slots of ``scope`` code points that its scope touches and
    meets those that start there, so that it meets few, whatever the text's length.
    """
    roles = F.array(*(F.lit(ROLES[k]) for k in KINDS))
    several = F.size(F.array_distinct(F.transform(F.concat("base", "weak"), lambda x: F.get(roles, x["k"])))) > 1
    some = found.where(several).groupBy("doc_id", "key").agg(F.first("base").alias("base"), F.first("weak").alias("weak"))
    rows = some.select("doc_id", "key", F.explode(F.concat("base", "weak")).alias("x")).select("doc_id", "key", "x.*")
    # a weak span inside or across a base span is no part of its own
    order = Window.partitionBy("doc_id", "key").orderBy("s", "e", "k")
    strong = F.col("k") < len(BASE)
    end = F.max(F.when(strong, F.col("e"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    start = F.min(F.when(strong, F.col("s"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    apart = strong | (F.coalesce(end <= F.col("s"), F.lit(True)) & F.coalesce(start >= F.col("e"), F.lit(True)))
    rows = rows.withColumn("apart", apart).where("apart").select("doc_id", "key", F.struct("s", "k", "e").alias("x"), F.get(roles, F.col("k")).alias("role"))
    rows = common.stash(rows, "parts-apart")

    width = max(1, scope)
    left = rows.withColumn("slot", F.explode(F.sequence(F.floor(F.col("x.s") / width), F.floor((F.col("x.e") + scope) / width)))).alias("a")
    right = rows.withColumn("slot", F.floor(F.col("x.s") / width)).alias("b")
    near = F.expr(f"a.doc_id <=> b.doc_id and a.key = b.key and a.slot = b.slot and a.x < b.x and b.x.s <= a.x.e + {scope} and a.role <> b.role")
    pairs = left.join(right, near).select("a.doc_id", "a.key", F.col("a.x").alias("x"), F.col("a.role").alias("role"), F.col("b.x").alias("y"), F.col("b.role").alias("other"))
    pairs = common.stash(pairs, "pairs")

    both = pairs.select("doc_id", "key", "x", "role", "other").unionByName(pairs.select("doc_id", "key", F.col("y").alias("x"), F.col("other").alias("role"), F.col("role").alias("other")))
    met = both.where(F.col("x.k") >= len(BASE)).groupBy("doc_id", "key", "x", "role").agg(*(F.max(F.col("other") == r).alias(r) for r in ("identifier", "secret", "endpoint")))
    complete = F.expr("case role when 'identifier' then secret when 'secret' then identifier or endpoint else identifier and secret end")
    more = met.where(complete).select("doc_id", "key", "x", F.lit(None).cast("struct<x:struct<s:int,k:int,e:int>,y:struct<s:int,k:int,e:int>>").alias("link"))
    link = pairs.where("role = 'secret' or other = 'secret'").select("doc_id", "key", F.lit(None).cast("struct<s:int,k:int,e:int>").alias("x"), F.struct("x", "y").alias("link"))
    return more.unionByName(link).groupBy("doc_id", "key").agg(F.collect_list("x").alias("more"), F.array_sort(F.collect_list("link")).alias("links"))


def scan(docs: DataFrame, scope: int = 200) -> DataFrame:
    """One row per document: ``doc_id``, ``key``, ``base`` and ``all``, arrays of (s, k, e): start, number of the kind in KINDS, end (exclusive), in
    code points; and ``links``, pairs of such spans that belong together, one of each a secret.

    Base spans always stand; weak ones (accounts, mixed-case blobs, endpoints) only where complementary parts are near (``linked``).  Null text
    counts as empty, repeated rows have equal results, a null doc_id is a value like others; an empty table gives an empty result; other columns are ignored.
    """
    found = common.stash(parts(docs), "parts")
    more = common.stash(linked(found, scope), "linked")
    both = found.alias("f").join(more.alias("m"), F.expr("f.doc_id <=> m.doc_id and f.key = m.key"), "left")
    every = F.array_sort(F.concat("f.base", F.coalesce("m.more", F.array().cast(SPAN))))
    return both.select("f.doc_id", "f.key", "f.base", every.alias("all"), "m.links")


def report(docs: DataFrame, scope: int = 200) -> DataFrame:
    """``scan`` as counts, a digest of the base spans, the list of all spans, and ``links``: which spans belong together, as first+second."""
    found = scan(docs, scope)
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {i})) as long)").alias(f"n_{k}") for i, k in enumerate(BASE)]
    names = ", ".join(f"'{k}'" for k in KINDS)
    link = f"coalesce(array_join(transform(links, p -> concat_ws('+', transform(array(p.x, p.y), x -> concat(array({names})[x.k], ':', x.s, ':', x.e)))), ','), '')"
    return found.select("doc_id", *counts, F.sha2(F.expr(_listed("base")), 256).alias("base_sha256"), F.expr(_listed("all")).alias("spans"), F.expr(link).alias("links"))


def redact(docs: DataFrame, scope: int = 200) -> DataFrame:
    """``docs`` with each span of ``scan`` replaced by its kind in brackets; overlapping spans become one, under the first's kind.

    Null texts, and texts without spans, stay as they are; all other columns stay, whatever their names; an empty table stays empty.
    """
    found = scan(docs, scope).where(F.size("all") > 0).groupBy("doc_id", "key").agg(F.first("all").alias("all"))
    doc, key, spans_ = (common.fresh(docs, f"secrets_{x}") for x in ("doc", "key", "spans"))
    found = common.stash(found.select(F.col("doc_id").alias(doc), F.col("key").alias(key), F.col("all").alias(spans_)), "spans")
    names = ", ".join(f"'{k}'" for k in KINDS)
    clean = F.expr(f"""aggregate({spans_}, named_struct('at', 0, 'out', cast(array() as array<string>)),
        (acc, x) -> if(x.s >= acc.at,
            named_struct('at', x.e, 'out', concat(acc.out, array(substring(text, acc.at + 1, x.s - acc.at), '[', array({names})[x.k], ']'))),
            named_struct('at', greatest(acc.at, x.e), 'out', acc.out)),
        acc -> concat(array_join(acc.out, ''), substring(text, acc.at + 1)))""")
    text = F.col("text").cast("string")
    joined = docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.md5(F.coalesce(text, F.lit(""))) == F.col(key)), "left")
    return joined.withColumn("text", F.when(F.col(spans_).isNull(), text).otherwise(clean)).select(*map(common.named, docs.columns))
