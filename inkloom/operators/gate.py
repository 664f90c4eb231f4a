"""The formal gate over translated chunks: text, provenance, review and terminology rules as joins and one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions.hashing import accepted_hashes
from inkloom.functions.loose_json import is_object
from inkloom.functions.text import MARKER, han_count, paragraphs, strip, word_count
from inkloom.operators import quality
from inkloom.operators.context import contiguity
from inkloom.operators.terms import approved, conflicts, term_matches

#: Kinds of artifacts, the best first.
KINDS = {"final": 1, "reviewed": 2, "draft": 3}

CHUNKS = "book long, chunk_id string, chunk_index int, page_start int, page_end int, source string, source_sha256 string"
ARTIFACTS = "book long, chunk_id string, kind string, text string"
META = "book long, chunk_id string, kind string, named_chunk string, source_sha256 string, translation_sha256 string, input_hash string, review_input_sha256 string, draft_sha256 string, review_sha256 string, invalid boolean"
REVIEWS = "book long, chunk_id string, text string, verdict string, n_issues int, source_sha256 string, translation_sha256 string, invalid boolean"
OPTIONS = f"book long, chunk_id string, chosen_kind string, expected_input string, paragraphs {quality.EXCEPTION}, skip_headings boolean, excused_terms array<string>"


def chosen(artifacts: DataFrame, options: DataFrame | None = None) -> DataFrame:
    """The artifact of each chunk that counts: the configured kind, else final before reviewed before draft."""
    rank = F.coalesce(*(F.when(F.col("kind") == k, n) for k, n in KINDS.items()), F.lit(9))
    rows = artifacts.withColumn("_rank", rank)
    if options is not None:
        wanted = options.filter("chosen_kind is not null").select("book", "chunk_id", "chosen_kind")
        rows = rows.join(wanted, ["book", "chunk_id"], "left").filter(F.col("chosen_kind").isNull() | (F.col("kind") == F.col("chosen_kind"))).drop("chosen_kind")
    return rows.groupBy("book", "chunk_id").agg(F.min_by("kind", "_rank").alias("kind"), F.min_by("text", "_rank").alias("target"))


def joined(chunks: DataFrame, artifacts: DataFrame, meta: DataFrame, reviews: DataFrame, options: DataFrame | None = None) -> DataFrame:
    """Every chunk with its chosen target, draft, metadata, review and options; nulls where there is none."""
    keys = ["book", "chunk_id"]
    rows = chunks.join(chosen(artifacts, options), keys, "left")
    rows = rows.join(artifacts.filter("kind = 'draft'").select(*keys, F.col("text").alias("draft")), keys, "left")
    m = meta.select(*keys, "kind", F.struct(*(c for c in meta.columns if c not in (*keys, "kind"))).alias("meta"))
    rows = rows.join(m, [*keys, "kind"], "left")
    r = reviews.select(*keys, F.struct(*(c for c in reviews.columns if c not in keys)).alias("review"))
    rows = rows.join(r, keys, "left")
    if options is None:
        spark = chunks.sparkSession
        options = spark.createDataFrame([], OPTIONS)
    return rows.join(options.drop("chosen_kind"), keys, "left")


def measured(rows: DataFrame) -> DataFrame:
    """Adds the paragraphs and headings of source and target, which several rules look at."""
    rows = rows.withColumns({"source_paragraphs": paragraphs(F.col("source")), "target_paragraphs": paragraphs(F.col("target"))})
    listed = lambda c, pattern: F.filter(c, lambda p: p.rlike(pattern))
    return rows.withColumns({"source_headings": listed("source_paragraphs", quality.SOURCE_HEADING), "target_headings": listed("target_paragraphs", quality.TARGET_HEADING)})


def _among(value: Column, text: Column) -> Column:
    """Whether a recorded hash is one of the text's own; a missing one isn't."""
    return F.coalesce(F.array_contains(accepted_hashes(text), value), F.lit(False))


def rules(simplified: str = "", allowed: dict[str, list[str]] | None = None) -> dict[str, tuple[Column | None, Column]]:
    """Conditions over the rows of ``measured(joined)``; nothing but the first two applies without a target."""
    target, draft, meta, review = F.col("target"), F.col("draft"), F.col("meta"), F.col("review")
    bad_meta, bad_review = F.coalesce(meta["invalid"], F.lit(False)), F.coalesce(review["invalid"], F.lit(False))
    has, has_meta, has_review = target.isNotNull(), meta.isNotNull() & ~bad_meta, review.isNotNull() & ~bad_review
    final, reviewed = F.coalesce(F.col("kind") == "final", F.lit(False)), F.coalesce(F.col("kind") == "reviewed", F.lit(False))
    none = F.lit(None).cast("string")
    bound = reviewed & has_meta & meta["review_input_sha256"].isNotNull()
    review_text = F.when(final, draft).otherwise(target)
    review_fits = F.when(bound, F.coalesce(review["translation_sha256"] == meta["review_input_sha256"], F.lit(False))).otherwise(_among(review["translation_sha256"], review_text))
    origin = F.coalesce(meta["input_hash"], meta["review_input_sha256"])
    expected = F.col("expected_input")
    ours, theirs, own, other = (F.col(c) for c in ("source_paragraphs", "target_paragraphs", "source_headings", "target_headings"))
    checked = has & ~F.coalesce(F.col("skip_headings"), F.lit(False))
    first = lambda c: F.get(c, F.lit(0))
    out = {
        "build_source_hash_mismatch": (~_among(F.col("source_sha256"), F.col("source")), F.col("source_sha256")),
        "translation_missing": (~has, none),
        "translation_meta_missing": (has & meta.isNull(), F.col("kind")),
        "translation_meta_invalid": (has & bad_meta, F.col("kind")),
        "review_missing": (has & review.isNull(), none),
        "review_invalid": (has & bad_review, none),
        "meta_source_hash_mismatch": (has & has_meta & ~meta["source_sha256"].eqNullSafe(F.col("source_sha256")), meta["source_sha256"]),
        "meta_translation_hash_mismatch": (has & has_meta & ~_among(meta["translation_sha256"], target), meta["translation_sha256"]),
        "meta_chunk_mismatch": (has & has_meta & ~meta["named_chunk"].eqNullSafe(F.col("chunk_id")), meta["named_chunk"]),
        "review_source_hash_mismatch": (has & has_review & ~review["source_sha256"].eqNullSafe(F.col("source_sha256")), review["source_sha256"]),
        "finalized_input_missing": (has & has_review & final & draft.isNull(), none),
        "finalized_draft_hash_mismatch": (has & has_review & final & has_meta & ~_among(meta["draft_sha256"], draft), meta["draft_sha256"]),
        "finalized_review_hash_mismatch": (has & has_review & final & has_meta & ~_among(meta["review_sha256"], review["text"]), meta["review_sha256"]),
        "reviewed_input_missing": (has & has_review & bound & draft.isNull(), none),
        "reviewed_review_input_hash_mismatch": (has & has_review & bound & draft.isNotNull() & ~_among(meta["review_input_sha256"], draft), meta["review_input_sha256"]),
        "review_translation_hash_mismatch": (has & has_review & ~review_fits, review["translation_sha256"]),
        "finalized_review_unresolved": (has & has_review & final & ~F.coalesce(review["verdict"].isin("pass", "revise"), F.lit(False)), review["verdict"]),
        "review_not_passed": (has & has_review & ~final & ~review["verdict"].eqNullSafe(F.lit("pass")), review["verdict"]),
        "review_issues_not_empty": (has & has_review & ~final & ~review["n_issues"].eqNullSafe(F.lit(0)), review["n_issues"]),
        "reviewed_input_hash_missing": (has & reviewed & origin.isNull(), none),
        "reviewed_input_hash_mismatch": (has & reviewed & expected.isNotNull() & (origin != expected), origin),
        "meta_input_hash_mismatch": (has & ~reviewed & expected.isNotNull() & ~meta["input_hash"].eqNullSafe(expected), meta["input_hash"]),
        "paragraph_count_mismatch": (has & quality.counts_mismatch(F.size(ours), F.size(theirs), F.col("paragraphs")), F.concat_ws(",", F.size(ours), F.size(theirs))),
        "chapter_heading_count_mismatch": (checked & (F.size(own) != F.size(other)), F.concat_ws(",", F.size(own), F.size(other))),
        "source_heading_position": (checked & (F.size(own) > 0) & ~first(ours).eqNullSafe(first(own)), none),
        "target_heading_position": (checked & (F.size(other) > 0) & ~first(theirs).eqNullSafe(first(other)), none),
    }
    return out | {code: (None, F.when(has, details)) for code, (_, details) in quality.text_rules(target, simplified, allowed).items()}


def term_issues(rows: DataFrame, glossary: DataFrame) -> DataFrame:
    """Approved terms that stand in a source while the target lacks their form, unless excused for the chunk.

    ``glossary`` has ``book``, ``source_term``, ``target_term`` and ``generated``;
    generated terms are matched with their case.
    """
    terms = glossary.filter((F.length("source_term") > 0) & (F.length("target_term") > 0)).select("book", "source_term", "target_term", "generated")
    made = F.coalesce(F.col("generated"), F.lit(False))
    texts = rows.filter(F.col("target").isNotNull()).select("book", "chunk_id", "source", "target", "excused_terms")
    stands = term_matches(texts, terms.filter(~made), "book", "source", "source_term").unionByName(term_matches(texts, terms.filter(made), "book", "source", "source_term", any_case=False))
    excused = F.coalesce(F.array_contains("excused_terms", F.col("source_term")), F.lit(False))
    missing = stands.filter(~excused & ~F.contains("target", F.col("target_term")))
    return missing.select(F.lit("approved_term_missing").alias("code"), _key(), F.col("source_term").alias("details")).distinct()


def _key() -> Column:
    return F.concat_ws(":", F.col("book").cast("string"), F.col("chunk_id")).alias("key")


def book_issues(rows: DataFrame, books: DataFrame) -> DataFrame:
    """Assembled books (``book``, ``text``) against what the chosen targets give."""
    piece = F.concat(F.format_string("<!-- %s; source pages %d-%d -->", "chunk_id", "page_start", "page_end"), F.lit("\n\n"), strip(F.col("target")))
    parts = rows.groupBy("book").agg(
        F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", F.when(F.col("target").isNotNull(), piece).alias("piece")))).alias("p")
    )
    wanted = F.concat(F.array_join(F.filter(F.col("p.piece"), lambda x: x.isNotNull()), "\n\n"), F.lit("\n"))
    both = parts.join(books.select("book", F.col("text").alias("book_text")), "book", "left")
    order = F.regexp_extract_all("book_text", F.lit(MARKER), F.lit(1))
    codes = {
        "assembled_book_missing": F.col("book_text").isNull(),
        "assembled_marker_order_mismatch": F.col("book_text").isNotNull() & (order != F.col("p.chunk_id")),
        "assembled_content_mismatch": F.col("book_text").isNotNull() & (F.col("book_text") != wanted),
    }
    none = F.lit(None).cast("string")
    return quality.issues(both, F.col("book"), {c: (w, none) for c, w in codes.items()})


def input_issues(books: DataFrame, chunks: DataFrame, glossary: DataFrame, bad_lines: DataFrame | None = None, generated: DataFrame | None = None, tie: str | None = None) -> DataFrame:
    """What is wrong with the inputs of whole books (``book``).

    Books without chunks or glossary, chunk ids that don't follow one another,
    approved terms with several targets (case folded, one issue a book),
    ``bad_lines`` (``book``, ``line_no``, ``line``) that are no JSON, and
    ``generated`` terminology (``book``, ``text``) that is no object of two lists of
    objects.
    """
    none = F.lit(None).cast("string")
    row = lambda df, code, details: df.select(F.lit(code).alias("code"), F.col("book").cast("string").alias("key"), details.cast("string").alias("details"))
    all_books = books.select("book").distinct()
    out = row(all_books.join(chunks.select("book").distinct(), "book", "left_anti"), "chunks_missing", none)
    out = out.unionByName(row(all_books.join(glossary.select("book").distinct(), "book", "left_anti"), "glossary_missing", none))
    out = out.unionByName(row(contiguity(chunks, "book", "chunk_index", "chunk_id", tie).groupBy("book").agg(F.min("chunk_id").alias("first")), "chunk_order_invalid", F.col("first")))
    several = conflicts(approved(glossary) if "status" in glossary.columns else glossary, ["book"], "source_term", "target_term")
    out = out.unionByName(row(several.groupBy("book").agg(F.array_join(F.array_sort(F.collect_set("term")), "|").alias("terms")), "glossary_conflict", F.col("terms")))
    if bad_lines is not None:
        out = out.unionByName(row(bad_lines, "chunk_json_invalid", F.col("line_no")))
    if generated is not None:
        value = F.try_parse_json("text")
        kinds = [F.schema_of_variant(F.try_variant_get(value, f"$.{k}", "variant")) for k in ("terms", "characters")]
        listed = [F.coalesce(k.startswith("ARRAY<OBJECT") | (k == "ARRAY<VOID>"), F.lit(True)) for k in kinds]
        out = out.unionByName(row(generated.filter(~(is_object(value) & listed[0] & listed[1])), "generated_glossary_invalid", none))
    return out


def run_gate(
    chunks: DataFrame, artifacts: DataFrame, meta: DataFrame, reviews: DataFrame, glossary: DataFrame, books: DataFrame | None = None, options: DataFrame | None = None,
    simplified: str = "", allowed: dict[str, list[str]] | None = None,
) -> DataFrame:
    """All issues of all books: (``code``, ``key``, ``details``)."""
    rows = joined(chunks, artifacts, meta, reviews, options)
    found = quality.issues(measured(rows), _key(), rules(simplified, allowed)).unionByName(term_issues(rows, glossary))
    return found if books is None else found.unionByName(book_issues(rows, books))


def scoped_checks(rows: DataFrame, glossary: DataFrame, low: float = 0.35, high: float = 2.5) -> DataFrame:
    """The weaker checks of a range of chunks (``book``, ``chunk_id``, ``source``, ``target``)."""
    ratio = han_count(F.col("target")) / F.greatest(F.lit(1), word_count(F.col("source")))
    marks = F.filter(F.array(*map(F.lit, ("TODO", "???", "[[", "TRANSLATION:"))), lambda m: F.contains(F.col("target"), m))
    has = F.col("target").isNotNull()
    found = quality.issues(
        rows,
        _key(),
        {
            "missing_translation": (~has, F.lit(None).cast("string")),
            "length_ratio": (has & ((ratio < low) | (ratio > high)), F.bround(ratio, 3)),
            "placeholder": (has & (F.size(marks) > 0), F.array_join(marks, "|")),
        },
    )
    terms = glossary.filter((F.length("source_term") > 0) & (F.length("target_term") > 0))
    stands = term_matches(rows.filter(has).select("book", "chunk_id", "source", "target"), terms.select("book", "source_term", "target_term"), "book", "source", "source_term", whole=False)
    lost = stands.filter(~F.contains("target", F.col("target_term")))
    return found.unionByName(lost.select(F.lit("approved_term_missing").alias("code"), _key(), F.col("source_term").alias("details")))
