"""Every stage of the pipeline on what the stage before kept, against brute-force versions."""

from collections import Counter, defaultdict

import corpus_pipeline
from tests.llm.test_models import check_pieces, library_encode
from tests.llm.test_near import brute_lines, lcs, union
from tests.llm.util import ODD, SMALL, docs

from tidemark.llm import mixing, registry, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    functions = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")

    def stage(name, df):
        out = spark.createDataFrame(functions[name](spark, df, SMALL).collect(), df.schema)
        assert out.columns == COLUMNS
        return out, {r["doc_id"]: r["text"] for r in df.collect()}, out.collect()

    toxic = {r["doc_id"] for r in toxicity.classify(docs, labels).where("toxic").collect()}
    docs, before, after = stage("toxicity", docs)
    assert {r["doc_id"] for r in after} == before.keys() - toxic

    docs, before, after = stage("line_dedup", docs)
    gone = brute_lines(sorted(before.items()))
    for r in after:
        lines = before[r["doc_id"]].split("\n")
        assert r["text"] == "\n".join(x for n, x in enumerate(lines) if n not in gone.get(r["doc_id"], []))

    docs, before, after = stage("near_dedup", docs)
    seqs = {}
    for i, t in before.items():
        w = t.split()
        seqs[i] = [tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))] if w else []
    sets = {i: set(s) for i, s in seqs.items()}
    pairs = []
    for i in before:
        for j in before:
            if i < j and (before[i] == before[j] or 1.4 * len(sets[i] & sets[j]) > 0.8 * max(len(seqs[i]), len(seqs[j]))):
                m = lcs(seqs[i], seqs[j])
                if before[i] == before[j] or m / (len(seqs[i]) + len(seqs[j]) - m) >= 0.8:
                    pairs.append((i, j))
    assert {r["doc_id"] for r in after} == set(union(pairs, before).values())

    times = {r["doc_id"]: r["copies"] for r in mixing.systematic_mix(docs).collect()}
    docs, before, after = stage("mixing", docs)
    assert Counter(r["doc_id"] for r in after) == Counter({i: n for i, n in times.items() if n})

    pieces = corpus_pipeline.pack(spark, docs.coalesce(1), SMALL).collect()
    path, _ = registry.byte_bpe()
    unique = defaultdict(list)  # a document that the mix took n times has each piece n times
    for p in pieces:
        unique[p["doc_id"]].append(p)
    copies = Counter(r["doc_id"] for r in after)
    encode = library_encode(path)
    for r in {r["doc_id"]: r for r in after}.values():
        n = len(encode(r["text"] or "")) + 1
        assert sum(p["length"] for p in unique[r["doc_id"]]) == n * copies[r["doc_id"]]
    one = [r for r in after if copies[r["doc_id"]] == 1]
    assert one
    assert check_pieces(corpus_pipeline.pack(spark, spark.createDataFrame(one, docs.schema), SMALL).collect(), {r["doc_id"]: r["text"] for r in one}, encode) == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.count() > 0 and "sequence_id" in out.columns


def test_stages_on_odd_rows_and_empty_tables(spark, tmp_path):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").limit(50)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    odd = docs(spark, ODD).selectExpr("*", "1 as __at", "2 as __n", "3 as __text", "4 as __removed", "5 as n", "6 as times", "7 as copies", "8 as rid")
    for frame in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, str(tmp_path))
            assert out.columns == frame.columns, name
            rows = out.collect()
            assert len(rows) <= 3 * len(ODD) and all((r["__at"], r["__n"], r["__text"], r["__removed"], r["n"], r["rid"]) == (1, 2, 3, 4, 5, 8) for r in rows)
        pieces = corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path))
        assert (pieces.count() > 0) == (frame is odd)


def test_equal_short_lines_go_in_the_pipeline(spark):
    df = docs(spark, [(1, "Les.\na line of its own", "s"), (2, "Les.\nanother line here", "s")])
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_lines(spark, df, SMALL).collect()}
    assert out == {1: "Les.\na line of its own", 2: "another line here"}
