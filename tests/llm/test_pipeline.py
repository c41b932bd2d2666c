"""The pipeline against plain Python, its stages' columns, and the entry module."""

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tideline.llm import pii, queries

from .test_operators import WORD, plain_components, plain_mix, plain_pairs, plain_quality, plain_sanitised, plain_stats, ranks  # noqa: F401


@pytest.fixture(scope="module")
def sf_dir(docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{path}/documents.parquet")
    return path


def cut(text, n):
    for i, m in enumerate(WORD.finditer(text), 1):
        if i == n:
            return text[: m.end()]


def test_pipeline(spark, sf_dir, ranks):  # noqa: F811
    from .conftest import rows

    good = [r for r, (ok, _) in zip(rows(), plain_quality(rows()), strict=True) if ok]
    assert {r[0] for r in rows() if not plain_stats(r[1])[-1]} - {r[0] for r in good} >= set(range(140, 146))  # the estimate's work
    groups = plain_components([(r[0], r[1]) for r in good], 5, 80)
    kept = [r for r, (_, _, c) in zip(good, groups, strict=True) if r[0] == c]
    pairs = plain_pairs([r[1] for r in kept], pii.THRESHOLD, pii.SUPPORT)
    clean = [(r[0], plain_sanitised(r[1], pairs), r[3]) for r in kept]
    taken = {d: (n, t) for d, n, _, _, t in plain_mix(clean)}
    want = []
    for d, text, _ in clean:
        n, t = taken[d]
        want += [(d, ranks.encode_ordinary(x)) for x in [text] * (t // n) + ([cut(text, t % n)] if t % n else [])]
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got)
    assert sorted((r.doc_id, r.ids) for r in got) == sorted(want)


def test_run_leaves_one_table(spark, sf_dir):
    """Stages' tables go: only what the last stage reads stays."""
    from pathlib import Path

    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    left = lambda: {str(x): x.name for d in shared.iterdir() for x in d.iterdir() if not x.name.startswith(".")}
    there = left()
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert [left()[x] for x in left().keys() - there.keys()] == ["source_mixing"]


def test_rejected_rows_are_known_by_group(spark, sf_dir):
    """The same id and text in two groups: what one group rejects stays in the other."""
    g = np.random.default_rng(3)
    words_ = ["".join(g.choice(list("abcdefgh"), 5)) for _ in range(200)]
    text = lambda mark: " ".join(str(x) + mark for x in g.choice(words_, 80))
    odd = text("#$%")
    rows = [(i, text(""), "en", "a", 1) for i in range(80)] + [(i, text("#$%"), "en", "b", 1) for i in range(100, 220)] + [(999, odd, "en", "a", 1), (999, odd, "en", "b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.source) for r in corpus_pipeline.quality_rules(spark, df, "").collect()]
    assert (999, "a") not in got and (999, "b") in got and len(got) == 201


def test_stages(spark, docs, sf_dir):
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf_dir).collect() == [], name


def test_duplicates_leave_one_of_equal_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, "en", "a", 1)] * 3 + [(2, text, "en", "a", 1), (None, text, "en", "a", 1), (3, "", "en", "a", 0), (4, None, "en", "a", 0), (None, "x y z", "en", "a", 0), (1, "another text with the same id", "en", "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    assert got == [(False, 1, "another text with the same id"), (False, 1, text), (False, 3, ""), (False, 4, ""), (True, 0, "x y z")]


def test_entry():
    import __spark_entry__ as entry

    found = entry.queries()
    assert {"pipeline", *queries.queries()} <= found.keys() and len(queries.queries()) == 10
    assert entry.oracle_sql().keys() <= found.keys()


def test_stages_hand_over_bounded_batches(spark):
    """A stage bounds the bytes that tasks hand to Python at a time, whatever the rows' width; a limit of the session's own stays."""
    from tideline.llm.common import BATCH_BYTES, BATCH_LIMIT

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    wide = spark.range(0, 3000, 1, 1).selectExpr("id as doc_id", "repeat('word ', 600) as text", "'en' as lang", "'a' as source", "3000L as n_chars")
    stages = [f for name, f in corpus_pipeline.STAGES if name != "source mixing"]
    assert len(stages) == 4
    was = spark.conf.get(BATCH_LIMIT, None)
    try:
        for stage in stages:
            spark.conf.unset(BATCH_LIMIT)
            after = stage(spark, wide.limit(3), "")
            assert after.columns
            got = wide.mapInArrow(sizes, "n long, bytes long").collect()
            assert sum(r["n"] for r in got) == 3000 and max(r["bytes"] for r in got) < 2 * BATCH_BYTES
        spark.conf.set(BATCH_LIMIT, 7 << 20)
        stages[-1](spark, wide.limit(3), "")
        assert int(spark.conf.get(BATCH_LIMIT).rstrip("b")) == 7 << 20
    finally:
        spark.conf.set(BATCH_LIMIT, was) if was else spark.conf.unset(BATCH_LIMIT)


def test_keys_are_sent_in_bounded_batches():
    """All keys of a block arrive, those that it holds twice known, in batches of SENT rows at most."""
    from tideline.llm.parity_join import SENT, _keyed

    key = np.arange(3 * SENT) // 2 * 7
    held = [(np.arange(len(key)), np.full(len(key), 9, np.int32), key)]
    got = [*_keyed([(x[:5], y[:5], z[:5]) for x, y, z in held] + [(x[5:], y[5:], z[5:]) for x, y, z in held])]
    assert max(map(len, got)) <= SENT and len(got) == 3
    rows = pa.Table.from_batches(got).to_pylist()
    assert sorted((r["node"], r["key"]) for r in rows) == [*zip(range(len(key)), key.tolist(), strict=True)]
    assert all(r["known"] and r["n"] == 9 and r["salt"] == (r["node"] if r["node"] % 2 else 0) for r in rows)
