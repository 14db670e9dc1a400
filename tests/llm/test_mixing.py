import pytest
from helpers import rows

from sieveline.llm import mixing as M

TARGETS = "source string, target_share double, max_repeats int"


def counts(spark, items):
    return spark.createDataFrame(items, "doc_id long, source string, n_tokens long")


def test_shares_caps_and_copies(spark):
    items = [(n, "big", 10 + n % 7) for n in range(4000)] + [(10_000 + n, "small", 20) for n in range(50)] + [(20_000 + n, "other", 5) for n in range(100)] + [(30_000, None, 9)]
    c = counts(spark, items)
    total = sum(n for _, _, n in items)
    planned = M.plan(c, spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("absent", 0.1, 2), ("other", None, 5)], TARGETS))
    got = M.chosen(c, planned).collect()
    used = {}
    for r in got:
        used[r["source"]] = used.get(r["source"], 0) + r["n_tokens"] * r["copies"]
    assert abs(used["big"] / total - 0.5) < 0.002 and used["small"] == 3 * 50 * 20 and set(used) == {"big", "small"}
    assert max(r["copies"] for r in got if r["source"] == "big") == 1 and {r["copies"] for r in got if r["source"] == "small"} == {3}


@pytest.mark.parametrize("partitions", [1, 3, 50])
def test_partitions_do_not_matter_and_sums_are_exact(spark, partitions):
    items = [(n, "hot" if n % 3 else "cold", n % 11, (n * 7919) % (3 * M.UNIT)) for n in range(2000)]
    df = spark.createDataFrame(items, "doc_id long, source string, n_tokens long, units long")
    got = {(r["source"], r["n_tokens"], r["doc_id"]): r["copies"] for r in M.systematic(df, "source", ["n_tokens", "doc_id"], "units", 5, partitions).collect()}
    want, sums = {}, {}
    for n, s, t, u in sorted(items, key=lambda x: (x[1], x[2], x[0])):
        before = sums.get(s, M._offset(s, 5))
        sums[s] = before + u
        want[s, t, n] = sums[s] // M.UNIT - before // M.UNIT
    assert got == want


def test_token_counts_are_those_of_the_tokenizer(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(M.default_tokenizer(spark))
    t.encode_special_tokens = True
    texts = ["hello world", "", None, "<|endoftext|>", "ü" * 50_000, "Grüße, 世界"]
    df = spark.createDataFrame([(n, x, "s", "clash") for n, x in enumerate(texts)], "doc_id long, text string, source string, n_tokens string")
    got = dict((r["doc_id"], r["n_tokens"]) for r in M.token_counts(df.union(df)).collect())
    assert got == {n: len(t.encode(x or "", add_special_tokens=False).ids) for n, x in enumerate(texts)} and M.token_counts(df.union(df)).count() == len(texts)


def test_report_and_empty_tables(spark):
    docs = spark.createDataFrame([(n, "word " * 20, "a" if n % 2 else "b") for n in range(400)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.25, 1), ("b", 0.75, 1), ("b", 0.7, 9), (None, 0.5, 1), ("c", 0.1, 2)], TARGETS)
    r = {x["source"]: x for x in M.shares(docs, targets).collect()}
    assert set(r) == {"a", "b", "c"} and abs(r["a"]["actual_share"] - 0.25) < 0.01 and r["b"]["actual_share"] == 0.5 and r["b"]["shortfall_tokens"] > 0 and r["c"]["used_tokens"] == 0
    assert M.mix(docs.limit(0), targets).collect() == [] and M.mix(docs, targets.limit(0)).collect() == []
    assert len(M.shares(docs.limit(0), targets).collect()) == 3
    assert rows(M.mix(docs, targets)) == rows(M.mix(docs.repartition(7), targets))
