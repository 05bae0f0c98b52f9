"""Streams with state: citations over runs and clears equal the table's, answers are assembled and persisted once."""

import random

import pytest

from lexivec.operators import retrieval as R
from lexivec.streaming import streams as S


def write(spark, rows, schema, folder, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")


def drain(query):
    query.trigger(availableNow=True).start().awaitTermination()


def test_citations_over_runs_and_clears(spark, tmp_path):
    """Two runs of one checkpoint, sessions known from before, clears in both runs."""
    r = random.Random(9)
    schema = "session long, seq long, chunk long, clear boolean"
    rows = [(r.randrange(4), k, None if (c := r.random() < 0.06) else r.randrange(9), c) for k in range(300)]
    known = [(0, 100, 1), (0, 3, 2), (9, 1, 1)]
    source = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    run = lambda: drain(S.persisted(S.session_citations(source(), known=spark.createDataFrame(known, "session long, chunk long, citation long")), str(tmp_path / "out"), str(tmp_path / "cp")))
    write(spark, rows[:170], schema, tmp_path / "in", "a")
    run()
    write(spark, rows[170:], schema, tmp_path / "in", "b")
    run()
    got = sorted((x["session"], x["chunk"], x["citation"]) for x in spark.read.parquet(str(tmp_path / "out")).collect())
    # The table's way: what is known comes before all else.
    before = [(s, n - 1000, c, False) for s, c, n in known]
    table = R.citations_between(spark.createDataFrame(before + rows, schema))
    want = sorted((x["session"], x["chunk"], x["citation"]) for x in table.collect())
    for k in known:
        want.remove(k)
    assert got == want and len({x["epoch"] for x in table.collect()}) > 2


PARTS = "session long, message long, part int, kind string, text string, ms long"


def message(session, message_, texts, ms):
    return [(session, message_, 0, "start", None, ms), *[(session, message_, k, "text", t, None) for k, t in enumerate(texts)], (session, message_, len(texts), "finish", None, ms + 500)]


def test_answers_are_assembled_once(spark, tmp_path):
    """Parts in any order, twice, over several micro-batches; what comes after the end gives no second row."""
    r = random.Random(2)
    whole = {(s, m): [f"{s}.{m}.{k} " if k % 4 else None for k in range(s * m % 7)] for s in range(4) for m in range(5)}
    rows = [x for (s, m), t in whole.items() for x in message(s, m, t, 1000 * m)]
    rows += r.sample(rows, 30)
    r.shuffle(rows)
    rows += message(8, 8, ["never", "ends"], 5)[:-1] + [(8, 9, 2, "finish", None, 9), (8, 9, 1, "text", "b", None)]
    for k in range(4):
        write(spark, rows[k::4], PARTS, tmp_path / "in", f"p{k}")
    source = lambda: spark.readStream.schema(PARTS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = lambda: S.persisted(S.assembled(source()), str(tmp_path / "out"), str(tmp_path / "cp"))
    drain(query())
    write(spark, message(1, 1, ["late"], 1) + [(8, 9, 0, "text", "a", None), (8, 9, 0, "start", None, 3)], PARTS, tmp_path / "in", "later")
    drain(query())
    got = {(x["session"], x["message"]): (x["answer"], x["started_ms"], x["finished_ms"]) for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {**{(s, m): ("".join(x or "" for x in t), 1000 * m, 1000 * m + 500) for (s, m), t in whole.items()}, (8, 9): ("ab", 3, 9)}
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(got)


def test_a_batch_that_fails_is_written_once(spark, tmp_path):
    """The first run dies after its batch was written; the second writes it again and leaves no second row."""
    write(spark, [x for m in range(6) for x in message(1, m, ["a", "b"], m)], PARTS, tmp_path / "in", "a")
    source = lambda: spark.readStream.schema(PARTS).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    died, kept = [], []

    def also(written, number):
        if not died:
            died.append(number)
            raise RuntimeError("killed")
        kept.append((number, written.count()))

    run = lambda: drain(S.persisted(S.assembled(source()), str(tmp_path / "out"), str(tmp_path / "cp"), also))
    with pytest.raises(Exception, match="killed"):
        run()
    run()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(x["message"] for x in rows) == list(range(6)) and kept[0] == (died[0], 6)


def test_ingest_of_a_batch_that_fails(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.txt").write_text(f"text number {k} " * 20)
    died = []

    def chunker(docs):
        if not died:
            died.append(1)
            raise RuntimeError("killed")
        return docs

    run = lambda: S.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), chunker).start().awaitTermination()
    with pytest.raises(Exception, match="killed"):
        run()
    run()
    assert spark.read.parquet(str(tmp_path / "out/documents")).count() == spark.read.parquet(str(tmp_path / "out/chunks")).count() == 3
