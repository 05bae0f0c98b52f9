"""The automaton against plain search; texts cut into lanes, nulls, slices; patterns behind it against patterns alone."""

import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexivec.functions import automaton as A
from lexivec.functions import lexicon as L
from lexivec.functions import text as T
from lexivec.operators import domain as D
from lexivec.operators import guard as G


def plain(literals, texts):
    """For each text the numbers of the literals it has, A-Z as a-z."""
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return [{k for k, w in enumerate(literals) if w in low(t)} for t in texts]


def numbers(rows):
    return [{64 * k + b for k, x in enumerate(r.tolist()) for b in range(64) if x >> b & 1} for r in rows]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("abé ", min_size=1, max_size=5), min_size=1, max_size=90, unique=True), st.lists(st.one_of(st.none(), st.text("abABé x", max_size=60)), max_size=12), st.integers(1, 9))
def test_equals_plain_search(literals, texts, lane):
    keep, A.LANE = A.LANE, lane
    try:
        assert numbers(A.Automaton(tuple(literals)).scan(pa.array(texts, pa.string()))) == plain(literals, texts)
    finally:
        A.LANE = keep


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_slices_and_long_texts(kind):
    r = random.Random(1)
    literals = tuple({"".join(r.choice("abcd ") for _ in range(r.randrange(1, 30))) for _ in range(150)})
    texts = [None, "", *["".join(r.choice("abcdE ") for _ in range(n)) + literals[n % len(literals)] for n in (1, 1023, 1024, 1025, 5000, 40_000)], None]
    whole = pa.array(texts, kind)
    scan = A.Automaton(literals).scan
    assert numbers(scan(whole)) == plain(literals, texts) and numbers(scan(whole.slice(2, 5))) == plain(literals, texts)[2:7]
    assert scan(whole.slice(0, 0)).shape == (0, 3) and not scan(pa.array([None, None], kind)).any()


def test_bits_in_spark(spark):
    literals = tuple(f"w{k}x" for k in range(130))
    rows = [(k, None if k == 7 else f"say W{k}X and w{k + 64}x") for k in range(66)]
    d, seen = A.with_seen(spark.createDataFrame(rows, "id int, text string"), F.col("text"), literals)
    got = {r["id"]: (r["a"], r["b"], r["c"]) for r in d.select("id", seen.any(("w63x", "w127x")).alias("a"), seen.any(("w5x", "w64x")).alias("b"), seen.any(()).alias("c")).collect()}
    assert got[7][:2] == (None, None) and [k for k, v in got.items() if v[0]] == [63] and [k for k, v in got.items() if v[1]] == [0, 5, 64] and not any(v[2] for v in got.values())


def texts():
    """Texts out of the pieces of patterns, so that most lists match somewhere."""
    r = random.Random(3)
    words = sorted({w for p in (L.INJECTION, L.TOXICITY, L.INTEGRITY, [p for _, p in L.REACTIONS_ID + L.REACTIONS_EN], [p for _, p in L.DOCUMENT_TYPES]) for w in T.needs(p)})
    filler = ["the", "Report", "yang", "dengan", "is", "12.345", "ABSTRACT:\n", "Results \n", "Pendahuluan\n", "lampiran\n", "K", "İ", "previous instructions", "all", "?"]
    return [(k, None if k == 0 else " ".join(r.choice(words if r.random() < 0.3 else filler) for _ in range(r.randrange(60)))) for k in range(400)]


def test_patterns_behind_the_scan_equal_patterns_alone(spark):
    """What is scanned for never hides a match."""
    d = spark.createDataFrame(texts(), "doc_id long, text string").repartition(2)
    t = F.col("text")
    alone = d.select("doc_id", G.hits(t, L.INJECTION).alias("injections"), G.hits(t, L.TOXICITY).alias("toxic"), G.hits(t, L.INTEGRITY).alias("dishonest"), G.off_topic(t).alias("off_topic"), G.reaction(t).alias("reaction"))
    behind = G.validate_input(d).select(*alone.columns)
    assert sorted(map(repr, alone.collect())) == sorted(map(repr, behind.collect()))
    types = lambda x: {r["doc_id"]: r["doc_type"] for r in x.collect()}
    assert types(D.document_types(d)) == types(d.select("doc_id", T.doc_type(t).alias("doc_type")))
    assert len(set(types(D.document_types(d)).values())) > 8


def test_metadata_reads_its_table_once(spark):
    """One scan, no join, and the repair once for the text and once for the course code."""
    d = spark.createDataFrame(texts(), "doc_id long, text string")
    plan = D.metadata(d)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("ArrowEvalPython") == 1
    assert plan.count("200B") == 2


def test_places_of_many_matches(spark):
    """A text of 20,000 matches: places are summed by blocks."""
    text = "é1 " * 20_000 + "end"
    (row,) = spark.createDataFrame([(text,)], "t string").select(T.spans(F.col("t"), "[0-9]").alias("s")).collect()
    assert [x["start"] for x in row["s"]] == [3 * k + 1 for k in range(20_000)] and {x["value"] for x in row["s"]} == {"1"}
    (row,) = spark.createDataFrame([("none",)], "t string").select(T.spans(F.col("t"), "[0-9]").alias("s"), T.spans(F.lit(None).cast("string"), "a").alias("n")).collect()
    assert row["s"] == [] and row["n"] is None


def test_stems_in_compiled_code_equal_the_pattern(spark):
    r = random.Random(12)
    parts = [*L.SUFFIXES, *L.PREFIXES, "ka", "n", "i", "sa", "é", "12"]
    words = sorted({"".join(r.choice(parts) for _ in range(r.randrange(1, 6))) for _ in range(4000)})
    d = spark.createDataFrame([(w,) for w in words], "w string")
    got = T.with_stems(d, "w", "s").select("w", "s", T.stem(F.col("w")).alias("p")).collect()
    assert [x["w"] for x in got if x["s"] != x["p"]] == [] and sum(x["s"] != x["w"] for x in got) > 1000
