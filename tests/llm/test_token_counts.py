import pandas as pd

from millrace.llm import token_counts


def brute(lengths, limit):
    return sum(min(x, limit) for x in lengths)


def test_sums_equal_brute_force(spark):
    lengths = [0, 0, 3, 3, 3, 7, 511, 512, 513, 5000, 120000]
    counted = spark.createDataFrame([(x,) for x in lengths], "n_tokens long")
    sums = token_counts.suffix_sums(token_counts.histogram(counted)).cache()
    for r in sums.collect():
        assert r.docs == lengths.count(r.n_tokens)
        assert r.docs_longer == sum(x > r.n_tokens for x in lengths)
        assert r.tokens_longer == sum(x for x in lengths if x > r.n_tokens)
        assert (r.docs_total, r.tokens_total) == (len(lengths), sum(lengths))
        assert r.truncated_total == brute(lengths, r.n_tokens)
    limits = [0, 1, 3, 6, 512, 4096, 10**6]
    got = token_counts.totals_at(sums, spark.createDataFrame([(x,) for x in limits], "limit long")).collect()
    for r in got:
        assert r.docs_cut == sum(x > r.limit for x in lengths)
        assert r.truncated_total == brute(lengths, r.limit)
    for q in (0.01, 0.5, 0.9, 1.0):
        s = sorted(lengths)
        least = next(x for i, x in enumerate(s, 1) if sum(y <= x for y in s) >= q * len(s))
        assert token_counts.quantile(sums, q).first().n_tokens == least


def test_report_has_lengths_limits_and_quantiles(spark):
    lengths = [0, 3, 3, 700, 5000, 5000, 140000]
    sums = token_counts.suffix_sums(token_counts.histogram(spark.createDataFrame([(x,) for x in lengths], "n_tokens long")))
    rows = token_counts.report(sums).collect()
    of = {k: {r.n_tokens: r for r in rows if r.kind == k} for k in ("length", "limit")}
    assert of["length"].keys() == set(lengths) and of["limit"].keys() == set(token_counts.LIMITS)
    for r in [*of["length"].values(), *of["limit"].values()]:
        assert r.truncated_total == brute(lengths, r.n_tokens) and r.docs_longer == sum(x > r.n_tokens for x in lengths)
    by_share = {r.q: r.n_tokens for r in rows if r.kind == "quantile"}
    assert by_share == {q: sorted(lengths)[max(0, -int(-len(lengths) * q // 1) - 1)] for q in token_counts.QUANTILES}


def test_counts_whole_texts_and_nulls(spark):
    from millrace.llm.byte_bpe import public_vocabulary

    texts = [None, "", "one two", "one two", "word " * 20000]
    docs = spark.createDataFrame([(t, 1) for t in texts], "text string, n_tokens int")
    vocabulary = public_vocabulary()
    model = token_counts.encoding(*vocabulary)
    got = pd.Series([r.n_tokens for r in token_counts.lengths(docs, *vocabulary).collect()]).sort_values().tolist()
    assert got == sorted(len(model.encode_ordinary(t or "")) for t in texts)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "n_tokens long")
    sums = token_counts.suffix_sums(token_counts.histogram(docs))
    assert sums.count() == 0 and token_counts.report(sums).count() == 0
