import public_tokenizers as P
import pyarrow as pa

import corpus_pipeline
import __spark_entry__ as entry_points
from lexmill.llm import op4_bpe, op8_decontaminate, op10_quality
from lexmill.llm.queries import BYTE_RANKS
from tests.llm.helpers import SF, table
from tests.llm.test_duplicate_operators import groups_of, plain_fingerprint, plain_line_dedup


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    field = op10_quality.fit_field(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = {}
    for r in docs.collect():
        f = op10_quality.facts_of(r.text)
        if not f.base_failed and op10_quality.content_share(f, field) >= 0.5:
            rows[r.doc_id] = r.text
    rows = {i: t for (i, _), t in plain_line_dedup(list(rows.items())).items() if t.strip()}
    prints = {i: plain_fingerprint(t) for i, t in rows.items()}
    group = groups_of([(a, b) for a in prints for b in prints if b < a and (prints[a] ^ prints[b]).bit_count() <= 3], prints)
    rows = {i: t for i, t in rows.items() if group[i] == i}
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    block = op8_decontaminate.Block.of([r.item_id for r in bench], pa.array([r.text for r in bench]))
    ids = list(rows)
    leaked = {ids[x[0]] for x in op8_decontaminate.scan(pa.array([rows[i] for i in ids]), block, 13, 0.8)}
    codec = op4_bpe.Codec(P.path(BYTE_RANKS), P.PATTERN)
    want = {i: codec.encode(t) for i, t in rows.items() if i not in leaked}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: list(r.ids) for r in out} == want and all(r.round_trip for r in out) and len(want) > 60


def test_stages_keep_columns_and_take_empty_tables(spark):
    for rows in ([], [(1, None), (2, ""), (3, "x y z")]):
        docs = table(spark, rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, SF)
            assert after.columns == docs.columns
            docs = after
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() <= len(rows)


def test_every_operator_is_registered():
    names = entry_points.queries()
    assert sorted(n.split("_")[0] for n in names if n.startswith("op")) == sorted(f"op{i}" for i in range(1, 14)) and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "simhash near-dedup", "benchmark decontamination", "byte-level bpe"]
