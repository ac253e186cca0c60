import public_tokenizers
import test_line_dedup
import test_quality_rules
import test_simhash
from tokenizers import Tokenizer

import corpus_pipeline
from parcelwise.llm import quality_rules


def plain(docs, labels):
    """The pipeline on lists: (doc_id, ids) of what stays."""
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    table = {d: dict(zip(names, test_quality_rules.plain_measures(t), strict=True)) | {"stratum": lang} for d, t, lang in docs}
    sound = {d: m for d, m in table.items() if m["n_words"] >= 50 and 100 * m["n_repeat_words"] <= 50 * m["n_words"]}
    good = [m for d, m in sound.items() if labels.get(d) == 1]
    cuts = test_quality_rules.plain_cutoffs(good, quality_rules.FALSE_REJECTION, quality_rules.LEVEL)
    kept = [
        (d, t)
        for d, t, lang in docs
        if d in sound
        and all(
            cuts.get((lang, r.name)) is None or eval(r.value, {}, sound[d]) <= cuts[lang, r.name] for r in quality_rules.RULES
        )
    ]
    lines = test_line_dedup.brute(sorted(kept))
    ids = sorted(lines)
    roots = test_simhash.components([test_simhash.plain_fingerprint(lines[d]) for d in ids], 3)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {d: library.encode(lines[d], add_special_tokens=False).ids for d, r in zip(ids, roots, strict=True) if ids[r] == d}


def test_like_plain_stages(session, small):
    docs = session.read.parquet(f"{small}/documents.parquet").collect()
    labels = {r["doc_id"]: r["quality"] for r in session.read.parquet(f"{small}/labels.parquet").collect()}
    found = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(session, small).collect()}
    assert found == plain([(r["doc_id"], r["text"], r["lang"]) for r in docs], labels)
    assert 0 < len(found) < len(docs)


def test_stages_keep_the_columns(session, small):
    docs = session.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(session, docs.limit(0), small)
        assert out.columns == docs.columns and out.count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near-dedup", "mixing", "encoding"]


def test_stages_take_odd_rows(session, documents, small):
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "a b c " * 40, None, "x", 9)]
    docs = documents(*rows)
    for _, stage in corpus_pipeline.STAGES:
        assert "doc_id" in stage(session, docs, small).columns
        stage(session, docs, small).collect()
