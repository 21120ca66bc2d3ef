"""Every operator and stage on nulls, empty and long texts, repeated rows, empty tables and extra columns."""

import corpus_pipeline
import public_tokenizers
import pytest

from sievekit.llm import piece_transducer, quality_classifier, toxicity
from sievekit.llm.fingerprint import fingerprints
from sievekit.llm.minhash import near_duplicates
from sievekit.llm.packing import pack
from sievekit.llm.quality_rules import quality_rules
from sievekit.llm.sentence_dedup import sentence_dedup
from sievekit.llm.suffix_dedup import suffix_dedup
from sievekit.llm.token_counts import token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, `kept` boolean, z binary, id long, extra string"
LONG = "All of these words are here. Nobody counts them twice! " * 3000
ROWS = [
    (1, "One small text. It has two sentences.", "en"),
    (1, "One small text. It has two sentences.", "en"),
    (1, "The same id with another text.", None),
    (2, None, "en"),
    (3, "", "de"),
    (None, "A text without an id.", "en"),
    (None, None, None),
    (4, " \n\t ", ""),
    (5, LONG, "en"),
    (6, LONG, "en"),
    (7, "idiot " * 60 + "你好 ▁ 😀 <|endoftext|>", "xx"),
]
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def table(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", len(t or ""), 0.5, True, b"z", 9, "x") for i, t, g in rows], SCHEMA)


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


OPERATORS = {
    "quality": lambda d, lab: quality_classifier.quality_scores(d, quality_classifier.train(d, lab.selectExpr("doc_id", "quality AS grade"), 2), ["doc_id"]),
    "counts": lambda d, lab: token_counts(d, PIECES),
    "pieces": lambda d, lab: piece_transducer.decode(piece_transducer.encode(d, PIECES, ["doc_id"]), PIECES),
    "toxicity": lambda d, lab: toxicity.toxicity(d, toxicity.train(d, lab)),
    "sentences": lambda d, lab: sentence_dedup(d),
    "rules": lambda d, lab: quality_rules(d, ["doc_id", "extra"]),
    "suffixes": lambda d, lab: suffix_dedup(d, carry=["extra"]),
    "fingerprints": lambda d, lab: fingerprints(d),
    "minhash": lambda d, lab: near_duplicates(d),
}
LABELS = [(1, 1, 0), (2, 0, 0), (3, None, None), (5, 1, 0), (7, 0, 1), (7, 0, 1), (None, 1, 1), (99, 1, 1)]


@pytest.mark.parametrize("name", OPERATORS)
def test_one_result_for_every_row(spark, name):
    got = OPERATORS[name](table(spark, ROWS), labelled(spark, LABELS)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((i is None, i or 0) for i, _, _ in ROWS)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    if name == "minhash":
        assert {r["component_id"] for r in by[6]} == {5} and not by[6][0]["kept"] and by[2][0]["n_shingles"] == 0 and by[2][0]["kept"]
        assert all(r["component_id"] is None and r["kept"] for r in by[None])
        assert all(r["component_id"] == 1 for r in by[1])
    if name == "suffixes":
        assert all(by[i][0]["n_removed"] == by[i][0]["n_bytes"] == len(LONG) for i in (5, 6)) and by[2][0]["n_bytes"] == 0
    if name == "sentences":
        # two runs alternate in the long text: only the first two sentences lie in no later occurrence; its copy repeats them all
        assert by[6][0]["kept"] == "" and by[5][0]["n_removed"] == by[5][0]["n_sentences"] - 2 and by[3][0]["n_sentences"] == 0
    if name == "rules":
        assert by[2][0]["perplexity"] is None and by[2][0]["base_failed"] and not by[2][0]["kept"] and by[5][0]["base_failed"]
    if name == "fingerprints":
        assert by[5][0]["fingerprint"] == by[6][0]["fingerprint"] and by[5][0]["near_next"] == 1.0 and by[2][0]["near_next"] == 1.0
        assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    if name == "toxicity":
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    if name == "pieces":
        assert by[1][0]["text"] in {t for i, t, _ in ROWS if i == 1} and by[2][0]["text"] == "" and by[5][0]["text"] == LONG
    if name == "counts":
        assert by[2][0]["n_tokens"] == by[3][0]["n_tokens"] == 0 and by[5][0]["n_tokens"] > 30_000


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name](table(spark, []), labelled(spark, [])).collect() == []


def test_packing_edge_cases(spark):
    got = pack(table(spark, ROWS), WORDS).collect()
    ids = {}
    for r in got:
        ids.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    assert sum(r["length"] for r in got if r["start"] == 0 and r["doc_id"] in (2, 3, 4)) == 3
    assert pack(table(spark, []), WORDS).collect() == []


def test_stages_keep_columns_and_survive_empty_tables(spark, tmp_path):
    labelled(spark, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (ROWS, []):
        docs = table(spark, rows)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, str(tmp_path))
            assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
            got.collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
