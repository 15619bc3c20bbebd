"""The stages of the pipeline, each on what the one before kept."""

import corpus_pipeline as cp
from tidemark.llm import bpe, mixing, pii, simhash, toxicity
from tidemark.llm.common import materialize


def test_stages_take_effect_and_keep_columns(spark, sf, documents):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs, seen = documents, []
    for name, stage in cp.STAGES[:-1]:
        out = materialize(stage(spark, docs, sf), f"test-{name}")
        assert out.columns == documents.columns
        if name == "toxicity":
            scores = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, labels).collect()}
            assert {r.doc_id for r in out.collect()} == {i for i, s in scores.items() if s < 0.5}
        elif name == "near_duplicates":
            assert {r.doc_id for r in out.collect()} == {r.component_id for r in simhash.simhash_components(docs).collect()}
        elif name == "pii":
            assert out.count() == docs.count()
            left = pii.pii_digests(out).collect()
            assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in left) == 0
        else:
            assert out.select(mixing.words(out["text"]).alias("n")).groupBy().sum("n").first()[0] == mixing.mix_report(docs).groupBy().sum("taken").first()[0]
        docs = out
        seen.append(name)
    last = cp.STAGES[-1][1](spark, docs, sf).collect()
    assert sorted(map(tuple, last)) == sorted(map(tuple, bpe.token_digests(bpe.public_bpe(spark), docs).collect()))
    assert len(last) == docs.count() and seen == ["toxicity", "near_duplicates", "pii", "mixing"]
    assert sorted(map(tuple, cp.run(spark, sf).collect())) == sorted(map(tuple, last))


def test_a_cluster_needs_a_shared_folder():
    """No machine-local folder on a cluster; a local session gets a temporary one and keeps its settings."""
    import types

    import pytest

    from tidemark.llm import common

    conf = types.SimpleNamespace(get=lambda key, default=None: default)
    at = lambda master: types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master=master))
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(at(master))
    assert common.shared_dir(at("local[4]")) == common.shared_dir(at("local"))


def test_materialize_keeps_settings_and_discard_empties(spark):
    from tidemark.llm.common import discard, setting

    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    df = materialize(spark.range(10), "test-settings")
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before and df.count() == 10
    with setting(spark, "spark.tidemark.test", "1"):
        assert spark.conf.get("spark.tidemark.test") == "1"
    assert spark.conf.get("spark.tidemark.test", None) is None
    discard(df)
    assert spark.read.parquet(df.written_to).count() == 0
