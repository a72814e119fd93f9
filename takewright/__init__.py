"""Analytics over spoken-language datasets, written as DataFrame-to-DataFrame operators."""
