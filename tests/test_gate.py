import hashlib

import pytest

from inkloom.operators import gate, models

SOURCES = {"chunk-0001": "One\n\nMarlow arrived.", "chunk-0002": "He left."}
TARGETS = {"chunk-0001": "# 一\n\n馬洛抵達了。", "chunk-0002": "他離開了。"}


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


class Book:
    """Two chunks that pass; tests change one thing each."""

    def __init__(self):
        self.chunks = {k: [1, k, i, i, i + 1, s, sha(s)] for i, (k, s) in enumerate(SOURCES.items(), 1)}
        self.artifacts = {(k, "draft"): t for k, t in TARGETS.items()}
        self.meta = {(k, "draft"): dict(named_chunk=k, source_sha256=sha(SOURCES[k]), translation_sha256=sha(t)) for k, t in TARGETS.items()}
        self.reviews = {k: dict(text="{}", verdict="pass", n_issues=0, source_sha256=sha(SOURCES[k]), translation_sha256=sha(t)) for k, t in TARGETS.items()}
        self.glossary = [(1, "Marlow", "馬洛", False)]
        self.options = {}
        self.text = "".join(f"<!-- {k}; source pages {i}-{i + 1} -->\n\n{t}\n\n" for i, (k, t) in enumerate(TARGETS.items(), 1)).rstrip("\n") + "\n"

    def codes(self, spark, simplified="这", allowed=None):
        names = [c.split()[0] for c in gate.META.split(", ")][3:]
        meta = [(1, k, kind, *(m.get(n) for n in names)) for (k, kind), m in self.meta.items()]
        reviews = [(1, k, *(r.get(n) for n in ("text", "verdict", "n_issues", "source_sha256", "translation_sha256", "invalid"))) for k, r in self.reviews.items()]
        options = [(1, k, o.get("chosen_kind"), o.get("expected_input"), o.get("paragraphs"), o.get("skip_headings"), o.get("excused_terms")) for k, o in self.options.items()]
        found = gate.run_gate(
            spark.createDataFrame([tuple(c) for c in self.chunks.values()], gate.CHUNKS),
            spark.createDataFrame([(1, k, kind, t) for (k, kind), t in self.artifacts.items()], gate.ARTIFACTS),
            spark.createDataFrame(meta, gate.META),
            spark.createDataFrame(reviews, gate.REVIEWS),
            spark.createDataFrame(self.glossary, "book long, source_term string, target_term string, generated boolean"),
            spark.createDataFrame([(1, self.text)], "book long, text string"),
            spark.createDataFrame(options, gate.OPTIONS),
            simplified,
            allowed,
        )
        return {r["code"] for r in found.collect()}


@pytest.fixture
def book():
    return Book()


def test_passes(spark, book):
    assert book.codes(spark) == set()


def test_review_failures(spark, book):
    book.reviews["chunk-0001"] |= dict(verdict="revise", n_issues=1, translation_sha256="stale")
    assert book.codes(spark) == {"review_not_passed", "review_issues_not_empty", "review_translation_hash_mismatch"}


def test_hashes_of_either_kind(spark, book):
    book.chunks["chunk-0002"][6] = sha("He left.\0")
    book.meta["chunk-0002", "draft"]["source_sha256"] = book.reviews["chunk-0002"]["source_sha256"] = sha("He left.\0")
    assert book.codes(spark) == set()
    book.chunks["chunk-0002"][6] = "x"
    assert book.codes(spark) == {"build_source_hash_mismatch", "meta_source_hash_mismatch", "review_source_hash_mismatch"}


def test_missing_artifacts(spark, book):
    del book.meta["chunk-0001", "draft"], book.reviews["chunk-0001"], book.artifacts["chunk-0002", "draft"]
    assert book.codes(spark) == {"translation_meta_missing", "review_missing", "translation_missing", "assembled_content_mismatch"}


def test_stale_provenance_of_a_reviewed_text(spark, book):
    book.artifacts["chunk-0002", "reviewed"] = TARGETS["chunk-0002"]
    book.meta["chunk-0002", "reviewed"] = book.meta["chunk-0002", "draft"] | dict(input_hash="old")
    book.options["chunk-0002"] = dict(expected_input="new")
    assert book.codes(spark) == {"reviewed_input_hash_mismatch"}
    book.meta["chunk-0002", "reviewed"]["input_hash"] = None
    assert book.codes(spark) == {"reviewed_input_hash_missing"}
    book.meta["chunk-0002", "reviewed"]["input_hash"] = "new"
    assert book.codes(spark) == set()


def test_final_text_bound_to_draft_and_review(spark, book):
    draft = "他走了。"
    book.artifacts["chunk-0002", "final"] = TARGETS["chunk-0002"]
    book.artifacts["chunk-0002", "draft"] = draft
    book.meta["chunk-0002", "final"] = dict(named_chunk="chunk-0002", source_sha256=sha("He left."), translation_sha256=sha(TARGETS["chunk-0002"]), draft_sha256=sha(draft), review_sha256=sha("{}"))
    book.reviews["chunk-0002"] |= dict(verdict="revise", n_issues=2, translation_sha256=sha(draft))
    assert book.codes(spark) == set()
    book.reviews["chunk-0002"]["verdict"] = "escalate"
    book.meta["chunk-0002", "final"]["draft_sha256"] = "x"
    assert book.codes(spark) == {"finalized_review_unresolved", "finalized_draft_hash_mismatch"}


def test_paragraphs_headings_and_exceptions(spark, book):
    text = "# 一\n\n馬洛\n\n抵達了。"
    book.artifacts["chunk-0001", "draft"] = text
    book.meta["chunk-0001", "draft"]["translation_sha256"] = book.reviews["chunk-0001"]["translation_sha256"] = sha(text)
    book.text = book.text.replace(TARGETS["chunk-0001"], text)
    assert book.codes(spark) == {"paragraph_count_mismatch"}
    book.options["chunk-0001"] = dict(paragraphs=(None, 2, 3, None, "split in print"))
    assert book.codes(spark) == set()


def test_artifacts_that_are_no_objects(spark, book):
    book.meta["chunk-0001", "draft"]["invalid"] = True
    book.reviews["chunk-0002"]["invalid"] = True
    assert book.codes(spark) == {"translation_meta_invalid", "review_invalid"}


def test_allow_lists(spark, book):
    text = "# 一\n\n馬洛說 TODO 以及 the cat and the dog sat。这"
    book.artifacts["chunk-0001", "draft"] = text
    book.meta["chunk-0001", "draft"]["translation_sha256"] = book.reviews["chunk-0001"]["translation_sha256"] = sha(text)
    book.text = book.text.replace(TARGETS["chunk-0001"], text)
    assert book.codes(spark) == {"placeholder", "english_residue", "simplified_chinese"}
    assert book.codes(spark, allowed={"placeholder": ["TODO"], "english": ["the cat and the dog sat"], "simplified": ["这"]}) == set()


def test_inputs_of_books(spark):
    books = spark.createDataFrame([(1,), (2,), (3,)], "book long")
    chunks = spark.createDataFrame([(1, 1, "chunk-0001"), (1, 2, "chunk-0002"), (2, 1, "chunk-0001"), (2, 3, "chunk-0003")], "book long, chunk_index int, chunk_id string")
    glossary = spark.createDataFrame([(1, "Tide", "潮", "approved"), (1, "tide", "浪", " Approved"), (1, "sea", "海", "approved"), (2, "sea", "海", "approved"), (2, "SEA", "洋", "stale")], "book long, source_term string, target_term string, status string")
    bad = spark.createDataFrame([(1, 7, "{")], "book long, line_no long, line string")
    made = spark.createDataFrame([(1, '{"terms": [{"source_term": "a"}], "characters": []}'), (2, '{"terms": [1]}'), (3, "[]")], "book long, text string")
    got = sorted((r["code"], r["key"]) for r in gate.input_issues(books, chunks, glossary, bad, made).collect())
    assert got == [("chunk_json_invalid", "1"), ("chunk_order_invalid", "2"), ("chunks_missing", "3"), ("generated_glossary_invalid", "2"), ("generated_glossary_invalid", "3"), ("glossary_conflict", "1"), ("glossary_missing", "3")]


def test_term_boundaries_and_excuses(spark, book):
    book.glossary += [(1, "Lef", "左", False), (1, "he", "他們", True), (1, "HE", "它", True)]
    assert book.codes(spark) == set()
    book.glossary += [(1, "HE", "它", False)]
    assert book.codes(spark) == {"approved_term_missing"}
    book.options["chunk-0002"] = dict(excused_terms=["HE"])
    assert book.codes(spark) == set()


def test_assembly(spark, book):
    book.text = book.text.replace("chunk-0002", "chunk-0009")
    assert book.codes(spark) == {"assembled_marker_order_mismatch", "assembled_content_mismatch"}


def test_scoped(spark):
    rows = spark.createDataFrame([(1, "a", "one two three four", "一二三四"), (1, "b", "one two", "TODO ???"), (1, "c", "one", None), (1, "d", "Marlow came", "他來了啊")], "book long, chunk_id string, source string, target string")
    glossary = spark.createDataFrame([(1, "marlow", "馬洛")], "book long, source_term string, target_term string")
    got = sorted((r["key"], r["code"]) for r in gate.scoped_checks(rows, glossary).collect())
    assert got == [("1:b", "length_ratio"), ("1:b", "placeholder"), ("1:c", "missing_translation"), ("1:d", "approved_term_missing")]


def test_stage_skips_done_rows_and_keeps_errors(spark):
    def fail_on_two(model, instructions, text):
        if text == "two":
            raise TimeoutError("busy")
        return text.upper()

    df = spark.createDataFrame([(1, "one"), (2, "two"), (3, None)], "id long, t string")
    first = models.run_stage(df, "id", "t", "m", "do", fail_on_two)
    got = {r["id"]: (r["output"], r["error"]) for r in first.collect()}
    assert got == {1: ("ONE", None), 2: (None, "TimeoutError: busy")}
    again = models.run_stage(df, "id", "t", "m", "do", done=first)
    assert [(r["id"], r["output"]) for r in again.collect()] == [(2, "[m] two")]
    assert models.run_stage(df, "id", "t", "m", "other", done=first).count() == 2
    assert models.ordered_map(lambda x: x * 2, [3, 1, 2], 2) == [6, 2, 4] and models.model_of({"default": "d"}, "review") == "d"


def test_routing(spark):
    drafts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "key long, text string")
    reviews = spark.createDataFrame([(1, "pass", None), (2, "revise", "B"), (3, "escalate", "C")], "key long, verdict string, corrected string")
    texts, escalated = models.route_reviews(reviews, drafts)
    assert sorted((r["key"], r["text"], r["kind"]) for r in texts.collect()) == [(1, "a", "draft"), (2, "B", "reviewed"), (4, "d", "draft")]
    assert [r["key"] for r in escalated.collect()] == [3]
