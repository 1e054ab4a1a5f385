"""Each stage against its SQL on the stage's own input."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import database, rows  # noqa: E402

import corpus_pipeline  # noqa: E402
from kerbline.llm import common, oracles  # noqa: E402


def test_stages(spark, sf_dir):
    db, docs = database(sf_dir), common.stored(common.documents(spark, sf_dir))
    columns = ["doc_id", "n_chars", "text"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash", "decontaminate", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.toPandas()  # noqa: F841  read by DuckDB
        db.sql("CREATE OR REPLACE TABLE stage AS SELECT * FROM before")
        docs = common.stored(stage(spark, docs, sf_dir))
        assert docs.columns == list(before.columns)
        got = docs.toPandas()
        if name == "quality_rules":
            want = db.sql(f"WITH {oracles.quality_ctes('stage')} SELECT s.* FROM stage s JOIN qr_verdict USING (doc_id) WHERE kept").df()
        elif name == "line_dedup":
            want = db.sql(f"WITH {oracles.line_ctes('stage')} SELECT doc_id, text, length(text) AS n_chars FROM ld_text").df()
        elif name == "decontaminate":
            want = db.sql(f"WITH {oracles.decontaminate_ctes('stage')} SELECT s.* FROM stage s JOIN wm_report USING (doc_id) WHERE NOT contaminated").df()
        else:
            from kerbline.llm import simhash

            fp = {r.doc_id: simhash.fingerprint(r.text) for r in before.itertuples()}
            group: dict[int, int] = {}
            for i in sorted(fp):
                near = {group[j] for j in group if (fp[i] ^ fp[j]).bit_count() <= 2}
                least = min(near | {i})
                group = {j: least if g in near else g for j, g in group.items()} | {i: least}
            want = before[[group[i] == i for i in before.doc_id]]
        assert rows(got, columns) == rows(want, columns), name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).toPandas()
    assert set(packed.doc_id) == set(docs.toPandas().doc_id)
    assert corpus_pipeline.run(spark, sf_dir).count() == len(packed)
