"""The queries of the core package over the tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkloom.functions import hashing, text
from inkloom.operators import context, gate, graph, provenance, publish, quality, segment, terms
from inkloom.operators.packed import split_packed
from inkloom.session import read_table as table
from inkloom.sources.files import page_statistics

Query = Callable[[SparkSession, str], DataFrame]


def _long(column: Column) -> Column:
    return column.cast("long")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The names packed in ``characters.aliases``."""
    return split_packed(table(spark, folder, "characters"), "entry_id", "aliases", "alias")


def word_stats(spark: SparkSession, folder: str) -> DataFrame:
    """STR-7, STR-8: words and characters of every chunk."""
    return table(spark, folder, "chunks").select("chunk_key", _long(text.word_count(F.col("source"))).alias("words"), _long(F.length("source")).alias("chars"))


def source_inspection(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-1, FLT-9, FLT-10: page statistics of every book."""
    return page_statistics(table(spark, folder, "pages"), ["book_id"], "text")


def normalized_pages(spark: SparkSession, folder: str) -> DataFrame:
    """STR-1 to STR-4, STR-13: pages in NFKC as one line a block."""
    return table(spark, folder, "pages").select("page_key", text.normalize_page(F.col("text")).alias("normalized"))


def document_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """STR-12: paragraphs of documents with their position."""
    rows = table(spark, folder, "documents").select("doc_id", F.posexplode(text.paragraphs(F.col("text"))).alias("pos", "paragraph"))
    return rows.select("doc_id", _long(F.col("pos") + 1).alias("pos"), "paragraph")


def sentence_units(spark: SparkSession, folder: str) -> DataFrame:
    """GEN-1: documents as units of at most 60 words cut between sentences."""
    rows = table(spark, folder, "documents").filter("text is not null").select("doc_id", F.posexplode(segment.sentence_units(F.col("text"), F.lit(60))).alias("pos", "unit"))
    return rows.select("doc_id", _long(F.col("pos") + 1).alias("pos"), "unit")


def greedy_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """FOLD-4: paragraphs of documents filled greedily into chunks of 180 to 230 words."""
    rows = table(spark, folder, "documents").select("doc_id", text.paragraphs(F.col("text")).alias("p"))
    words, heads = F.transform("p", text.word_count), F.transform("p", segment.is_heading)
    numbers = rows.select("doc_id", F.posexplode(F.arrays_zip(F.col("p").alias("p"), words.alias("w"), segment.chunk_numbers(words, heads, F.lit(180), F.lit(230)).alias("c"))).alias("pos", "x"))
    return numbers.groupBy("doc_id", _long(F.col("x.c")).alias("chunk_index")).agg(F.count(F.lit(1)).alias("paragraphs"), F.sum(_long(F.col("x.w"))).alias("words"))


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every page once, as last loaded."""
    return context.latest(table(spark, folder, "pages"), ["book_id", "page"], ["loaded_at", "page_key"])


def page_continuation(spark: SparkSession, folder: str) -> DataFrame:
    """WIN-1: which pages go on with a paragraph."""
    pages = _pages(spark, folder).withColumn("normal", text.normalize_page(F.coalesce("text", F.lit(""))))
    return segment.continuation(pages, "book_id", "page", "text", "normal").select("page_key", "book_id", "page", "continues")


def book_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-2, STR-1, FOLD-2 to FOLD-5, GEN-1, HSH-1: books chunked by their own limits."""
    chunks = segment.chunk_books(_pages(spark, folder), "book_id", table(spark, folder, "project"), "chunk_target_words", "chunk_max_words")
    return chunks.select("book_id", "chunk_id", "chunk_index", "page_start", "page_end", "source_words", "source_chars", "source_sha256")


def heading_flags(spark: SparkSession, folder: str) -> DataFrame:
    """FLT-1, FLT-2: paragraphs of pages that open or end a part of the book."""
    rows = table(spark, folder, "pages").select("page_key", F.posexplode(text.paragraphs(F.col("text"))).alias("pos", "p"))
    rows = rows.filter(segment.is_heading(F.col("p")) | segment.is_stop_heading(F.col("p")))
    return rows.select("page_key", _long(F.col("pos") + 1).alias("pos"), F.col("p").alias("heading"))


def _emphasised(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their quotation marks as emphasis marks, which they have next to none of: ``*`` for double, ``**`` for single ones."""
    marked = F.regexp_replace(F.translate("text", "“”", "**"), "[‘’]", "**")
    return table(spark, folder, "documents").filter("text is not null").select("doc_id", marked.alias("text"))


def emphasis_parity(spark: SparkSession, folder: str) -> DataFrame:
    """FOLD-7, rule 37: documents with odd emphasis marks."""
    return _emphasised(spark, folder).select("doc_id", quality.emphasis_error(F.col("text")).alias("error")).filter("error is not null")


def bracket_balance(spark: SparkSession, folder: str) -> DataFrame:
    """FOLD-6: documents with brackets or quotation marks that don't match."""
    return table(spark, folder, "documents").select("doc_id", quality.bracket_error(F.col("text")).alias("error")).filter("error is not null")


def english_residue(spark: SparkSession, folder: str) -> DataFrame:
    """Rule 35: runs of English prose in documents."""
    drafts = table(spark, folder, "documents").select("doc_id", F.size(quality.english_runs(F.col("text"))).alias("n"))
    return drafts.filter("n > 0").select("doc_id", _long(F.col("n")).alias("runs"))


def script_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """STR-14, STR-15: Han characters of documents, and for each word."""
    words = text.word_count(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", _long(text.han_count(F.col("text"))).alias("han"), text.han_ratio(F.col("text"), words).alias("ratio"))


def _terms(spark: SparkSession, folder: str) -> DataFrame:
    rows = terms.approved(table(spark, folder, "glossary")).select("book_id", text.strip(F.col("source_term")).alias("source_term"), F.col("target_term"))
    return rows.filter(F.length("source_term") > 0)


def term_hits(spark: SparkSession, folder: str) -> DataFrame:
    """JN-1, FLT-8: approved terms that stand in the chunks of their book."""
    chunks = table(spark, folder, "chunks").select("chunk_key", "book_id", "source")
    return terms.term_matches(chunks, _terms(spark, folder).select("book_id", "source_term").distinct(), "book_id", "source", "source_term").select("chunk_key", "source_term")


def alias_hits(spark: SparkSession, folder: str) -> DataFrame:
    """JN-2: approved characters any of whose names (the bars part aliases) stands in a chunk, one row per chunk and entry."""
    people = terms.approved(table(spark, folder, "characters")).filter(F.length(text.strip(F.col("source_name"))) > 0)
    names = F.array_union(F.array(text.strip(F.col("source_name"))), F.coalesce(text.split_aliases(F.col("aliases")), F.array().cast("array<string>")))
    listed = people.select("book_id", "entry_id", F.explode(names).alias("name"))
    chunks = table(spark, folder, "chunks").select("chunk_key", "book_id", "source")
    return terms.term_matches(chunks, listed, "book_id", "source", "name", whole=False).select("chunk_key", "entry_id").distinct()


def proposal_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """JN-3, JN-16: proposals whose target lacks the approved form of their term."""
    glossary = _terms(spark, folder).filter(F.length("target_term") > 0).select("book_id", text.fold_term(F.col("source_term")).alias("k"), F.col("target_term").alias("wanted")).distinct()
    scans = table(spark, folder, "term_scans").filter(F.length("proposed_target") > 0).select("scan_id", "book_id", text.fold_term(text.strip(F.col("source_term"))).alias("k"), "proposed_target")
    return scans.join(glossary, ["book_id", "k"]).filter(~F.contains("proposed_target", F.col("wanted"))).select("scan_id", "wanted")


def glossary_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-3: terms of a book with several targets."""
    found = terms.conflicts(table(spark, folder, "glossary"), ["book_id"], "source_term", "target_term")
    return found.select("book_id", "term", "n_targets", F.array_join("targets", "|").alias("targets"))


def glossary_conflicts_exact(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-4: the same without folding."""
    found = terms.conflicts(table(spark, folder, "glossary"), ["book_id"], "source_term", "target_term", fold=False)
    return found.select("book_id", "term", "n_targets")


def term_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-2, ORD-3: proposals merged by folded term."""
    merged = terms.consolidate(table(spark, folder, "term_scans"), "book_id", ["scanned_at", "scan_id"])
    pairs = lambda c: F.array_join(F.transform(c, lambda e: F.concat(e["value"], F.lit("="), e["n"].cast("string"))), "|")
    return merged.select(
        "book_id", "term_key", "source_term", "mentions", "first_chunk", pairs("source_forms").alias("forms"), F.coalesce(pairs("candidate_targets"), F.lit("")).alias("targets"), F.coalesce(F.array_join("notes", "|"), F.lit("")).alias("notes")
    )


def new_terms(spark: SparkSession, folder: str) -> DataFrame:
    """JN-9: the first proposal of each term that the glossary doesn't know."""
    found = terms.new_terms(table(spark, folder, "term_scans"), table(spark, folder, "glossary"), "book_id", "source_term", "source_term", ["scanned_at", "scan_id"])
    return found.select("scan_id", "book_id", "term_key")


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk once, as last loaded."""
    return context.latest(table(spark, folder, "chunks"), ["book_id", "chunk_id"], ["loaded_at", "chunk_key"])


def neighbor_context(spark: SparkSession, folder: str) -> DataFrame:
    """WIN-2, WIN-3: the end of the chunk before and the beginning of the one after."""
    return context.neighbours(_chunks(spark, folder), "book_id", ["chunk_index"], "source", 120, 90).select("chunk_key", "before_text", "after_text")


def transitions(spark: SparkSession, folder: str) -> DataFrame:
    """WIN-4: chunks that open a chapter."""
    return context.transitions(_chunks(spark, folder), "book_id", ["chunk_index"], "source").select("chunk_key", "previous_end", "opening")


def assemble(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-10, AGG-14, STR-16: books put together again, by hash."""
    books = context.assemble(_chunks(spark, folder), "book_id")
    return books.select("book_id", "pieces", _long(F.length("book_text")).alias("chars"), hashing.hash_text(F.col("book_text")).alias("sha256"))


def marker_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """STR-17: the marker lines of assembled books."""
    found = context.markers(context.assemble(_chunks(spark, folder), "book_id"), "book_id", "book_text")
    return found.select("book_id", _long(F.col("pos")).alias("pos"), "chunk_id", "page_start", "page_end")


def contiguity(spark: SparkSession, folder: str) -> DataFrame:
    """WIN-5: chunks, as loaded, whose number isn't the next of their book."""
    return context.contiguity(table(spark, folder, "chunks"), "book_id", "chunk_index", "chunk_id", "chunk_key").select("chunk_key", _long(F.col("expected")).alias("expected"))


def latest_pages(spark: SparkSession, folder: str) -> DataFrame:
    """JN-5: of pages loaded again, the newest."""
    return context.latest(table(spark, folder, "pages"), ["book_id", "page"], ["loaded_at", "page_key"]).select("page_key", "book_id", "page")


def chosen_target(spark: SparkSession, folder: str) -> DataFrame:
    """JN-5: for each term of a book the target of the best status, approved before provisional before others."""
    status = F.lower(text.strip(F.col("status")))
    rank = F.when(status == "approved", 1).when(status == "provisional", 2).otherwise(3)
    rows = table(spark, folder, "glossary").filter(F.length("target_term") > 0).select("book_id", text.fold_term(text.strip(F.col("source_term"))).alias("term_key"), F.struct(rank.alias("rank"), F.col("entry_id")).alias("r"), "target_term")
    return context.choose(rows, ["book_id", "term_key"], "r", "target_term").select("book_id", "term_key", "target_term", F.col("r.entry_id").alias("entry_id"))


def hash_drift(spark: SparkSession, folder: str) -> DataFrame:
    """JN-13, FLT-17, rule 7: pages whose recorded hash isn't that of their text."""
    return provenance.drift(table(spark, folder, "pages"), "text", "sha256").select("page_key", "state")


def chunk_drift(spark: SparkSession, folder: str) -> DataFrame:
    """Rule 7 for chunks."""
    return provenance.drift(table(spark, folder, "chunks"), "source", "source_sha256").select("chunk_key", "state")


def content_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """HSH-1, HSH-2: both hashes of document texts that occur more than once."""
    rows = table(spark, folder, "documents").filter("text is not null").groupBy(hashing.hash_text(F.col("text")).alias("plain"), hashing.hash_parts(F.col("text")).alias("parts"))
    return rows.agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


def cache_misses(spark: SparkSession, folder: str) -> DataFrame:
    """FLT-16, INV-4: chunks of which no earlier load has the same hash."""
    chunks = table(spark, folder, "chunks").select("book_id", "chunk_id", F.col("source_sha256").alias("h"), "chunk_key", "loaded_at")
    newest = context.latest(chunks, ["book_id", "chunk_id"], ["loaded_at", "chunk_key"])
    older = chunks.join(newest.select("chunk_key"), "chunk_key", "left_anti")
    return provenance.work_left(newest, older, ["book_id", "chunk_id"], "h").select("chunk_key")


def status_counts(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-7: entries by status, zero where a known status doesn't occur; null and unknown ones count too."""
    known = spark.createDataFrame([(s,) for s in ("approved", "provisional", "rejected", "stale")], "status string")
    counted = table(spark, folder, "glossary").groupBy(F.lower(text.strip(F.col("status"))).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return counted.unionByName(known.withColumn("n", F.lit(0).cast("long"))).groupBy("status").agg(F.sum("n").alias("n"))


def usage_totals(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-8, JSN-2: sums of the numeric members of event properties."""
    rows = table(spark, folder, "events").select(F.explode(F.from_json("props", "map<string,string>")).alias("name", "v"))
    return rows.withColumn("v", F.expr("try_cast(v as double)")).filter("v is not null").groupBy("name").agg(F.round(F.sum("v"), 3).alias("total"), F.count(F.lit(1)).alias("n"))


def claim_order(spark: SparkSession, folder: str) -> DataFrame:
    """ORD-1: the twenty events that would be taken first."""
    return table(spark, folder, "events").orderBy(F.desc("value"), "ts", "event_id").limit(20).select("event_id", "value")


def ready_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """JN-10: orders all of whose lines are finished."""
    orders = table(spark, folder, "orders").select("o_orderkey")
    lines = table(spark, folder, "lineitem")
    unmet = lines.filter("l_linestatus <> 'F'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return orders.join(unmet, "o_orderkey", "left_anti")


def downstream_closure(spark: SparkSession, folder: str) -> DataFrame:
    """DAG-1, JN-12: all that depends on a region, down to its customers."""
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    edges = table(spark, folder, "nation").select(name("r", "n_regionkey").alias("source"), name("n", "n_nationkey").alias("target"))
    edges = edges.unionByName(table(spark, folder, "supplier").select(name("n", "s_nationkey").alias("source"), name("s", "s_suppkey").alias("target")))
    edges = edges.unionByName(table(spark, folder, "customer").select(name("n", "c_nationkey").alias("source"), name("c", "c_custkey").alias("target")))
    return graph.downstream(edges, spark.createDataFrame([("r1",)], "node string"))


def _planned(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    chunks = _chunks(spark, folder).withColumn("chunk_index", F.row_number().over(Window.partitionBy("book_id").orderBy("chunk_index")))
    return graph.plan_graph(spark, chunks, "book_id", "chunk_index")


def plan_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """DAG-2: every task of the plan of each book."""
    return _planned(spark, folder)[0]


def plan_edges(spark: SparkSession, folder: str) -> DataFrame:
    """DAG-2: what each task of the plan waits for."""
    return _planned(spark, folder)[1]


def invalidation_plan(spark: SparkSession, folder: str) -> DataFrame:
    """INV-1, INV-2: for each book the stages to do again: its source changed if a page's hash no longer fits, its references if an entry is newer than the book."""
    books = table(spark, folder, "project").select("book_id", "created_at")
    source = provenance.drift(table(spark, folder, "pages"), "text", "sha256").filter("state = 'changed'").select("book_id", F.lit("source").alias("dependency"))
    entries = table(spark, folder, "glossary").select("book_id", "updated_at")
    newer = entries.join(books, "book_id").filter("updated_at > created_at").select("book_id", F.lit("references").alias("dependency"))
    changed = books.join(source.unionByName(newer).distinct(), "book_id", "left").select("book_id", "dependency")
    return provenance.invalidation(spark, changed, ["book_id"])


def _book_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """GEN-2: assembled books as blocks behind their opening ones."""
    books = context.assemble(_chunks(spark, folder), "book_id").join(table(spark, folder, "project").select("book_id", "book_name", F.coalesce("author", F.lit("")).alias("author")), "book_id")
    return publish.blocks(books, "book_id", "book_text", "book_name", "author")


def publication_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """GEN-2: assembled books as blocks, counted by type."""
    rows = _book_blocks(spark, folder)
    return rows.groupBy("book_id", "type").agg(F.count(F.lit(1)).alias("blocks"), F.sum(_long(F.length("content"))).alias("chars"))


def block_batches(spark: SparkSession, folder: str) -> DataFrame:
    """FOLD-8, FOLD-9, HSH-5: blocks in hashed batches of a hundred."""
    return publish.batches(_book_blocks(spark, folder), "book_id")


def remote_batches(spark: SparkSession, folder: str) -> DataFrame:
    """PUB-1, PUB-3: the batches found again in uploaded bodies that lack the last block of every third book and hold a note by hand in every other one."""
    up = publish.marked(_book_blocks(spark, folder), "book_id")
    last = F.max("pos").over(Window.partitionBy("book_id"))
    up = up.withColumn("last", last).filter("pos < last or book_id % 3 <> 0").drop("last")
    notes = table(spark, folder, "project").filter("book_id % 2 = 0").select("book_id", F.lit(0).cast("long").alias("pos"), F.lit("paragraph").alias("type"), F.lit("by hand").alias("content"))
    return publish.discover(up.unionByName(notes), "book_id").select("book_id", "batch_no", "block_count", "present", "state", "batch_hash")


def batch_merge(spark: SparkSession, folder: str) -> DataFrame:
    """JN-14, PUB-2: batches of the books against those of an earlier state, in which every third is missing."""
    rows = publish.batches(_book_blocks(spark, folder), "book_id")
    earlier = rows.filter("batch_no % 3 <> 0").withColumn("block_count", F.when(F.col("batch_no") == 1, F.col("block_count")).otherwise(F.col("block_count") + (F.col("batch_no") % 2)))
    return publish.merge_batches(rows, earlier, "book_id")


def run_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """STR-20: documents cut every 2000 characters."""
    rows = table(spark, folder, "documents").filter("text is not null").select("doc_id", F.posexplode(text.fixed_pieces(F.col("text"), 2000)).alias("pos", "piece"))
    return rows.select("doc_id", _long(F.col("pos") + 1).alias("pos"), "piece")


def inline_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """STR-19: documents as runs of plain, bold and italic text."""
    return publish.inline_tokens(_emphasised(spark, folder), "doc_id", "text")


def slugs(spark: SparkSession, folder: str) -> DataFrame:
    """STR-11: slugs of book names."""
    return table(spark, folder, "project").select("book_id", text.slug(F.col("book_name")).alias("name_slug"))


def quality_issues(spark: SparkSession, folder: str) -> DataFrame:
    """Rules 7, 33 to 37 and SET-1: issues of all documents and chunk records by code."""
    found = quality.issues(table(spark, folder, "documents"), F.col("doc_id"), quality.text_rules(F.col("text"), quality.simplified_only()))
    chunk = provenance.drift(table(spark, folder, "chunks"), "source", "source_sha256")
    stale = chunk.filter("state = 'changed'").select(F.lit("build_source_hash_mismatch").alias("code"), F.col("chunk_key").cast("string").alias("key"), F.col("state").alias("details"))
    return quality.report([found, stale])


def input_issues(spark: SparkSession, folder: str) -> DataFrame:
    """Rules 1, 3, 4 and 5: what is wrong with the inputs of whole books."""
    book = F.col("book_id").alias("book")
    chunks = table(spark, folder, "chunks").filter("book_id is not null").select(book, "chunk_index", "chunk_id", "chunk_key")
    glossary = table(spark, folder, "glossary").filter("book_id is not null").select(book, "source_term", "target_term", "status")
    return gate.input_issues(table(spark, folder, "project").select(book), chunks, glossary, tie="chunk_key").select("code", "key")


def gate_issues(spark: SparkSession, folder: str) -> DataFrame:
    """Rules 7 to 11, 13, 14, 29 to 32, 34 to 38: the gate over all chunks; the n-th document of a book stands for the draft of its n-th chunk.

    Its record is made of the chunk's own hash and, for even documents, the draft's.
    """
    book = F.col("book_id").alias("book")
    nth = lambda order: F.row_number().over(Window.partitionBy("book_id").orderBy(order))
    chunks = _chunks(spark, folder).filter("book_id is not null").withColumn("n", nth("chunk_index"))
    docs = table(spark, folder, "documents").filter("book_id is not null and text is not null").select("book_id", "doc_id", "text").withColumn("n", nth("doc_id"))
    pairs = chunks.select("book_id", "n", "chunk_id", "source_sha256").join(docs, ["book_id", "n"])
    artifacts = pairs.select(book, "chunk_id", F.lit("draft").alias("kind"), "text")
    void = [F.lit(None).cast("string").alias(c) for c in ("input_hash", "review_input_sha256", "draft_sha256", "review_sha256")]
    own = F.when(F.col("doc_id") % 2 == 0, hashing.hash_text(F.col("text"))).otherwise(F.lit("none")).alias("translation_sha256")
    meta = pairs.filter("doc_id % 5 <> 0").select(book, "chunk_id", F.lit("draft").alias("kind"), F.col("chunk_id").alias("named_chunk"), "source_sha256", own, *void, (F.col("doc_id") % 7 == 0).alias("invalid"))
    reviews = spark.createDataFrame([], gate.REVIEWS)
    glossary = _terms(spark, folder).filter("book_id is not null").select(book, "source_term", "target_term", F.lit(False).alias("generated"))
    inputs = chunks.select(book, "chunk_id", "chunk_index", "page_start", "page_end", "source", "source_sha256")
    return gate.run_gate(inputs, artifacts, meta, reviews, glossary).filter("code not in ('review_missing')").select("code", "key").distinct()


def registry_dump(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-15: approved entries of each book as JSON lines, terms before characters, by hash."""
    terms_ = terms.approved(table(spark, folder, "glossary")).select("book_id", F.struct(F.lit(1).alias("k"), "entry_id").alias("at"), hashing.json_line("source_term", "target_term", "category", "status", "first_chunk", "notes").alias("line"))
    names = terms.approved(table(spark, folder, "characters")).select("book_id", F.struct(F.lit(2).alias("k"), "entry_id").alias("at"), hashing.json_line("source_name", "target_name", "aliases", "pronouns_or_gender", "role", "status", "notes").alias("line"))
    grouped = terms_.unionByName(names).groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("l"))
    return grouped.select("book_id", _long(F.size("l")).alias("entries"), hashing.hash_text(F.array_join("l.line", "\n")).alias("snapshot"))


def context_packets(spark: SparkSession, folder: str) -> DataFrame:
    """STR-27, INV-6, HSH-7: the input of each chunk with its book's frozen references, by hash."""
    chunks = context.neighbours(_chunks(spark, folder), "book_id", ["chunk_index"], "source")
    joined = chunks.join(registry_dump(spark, folder).select("book_id", "snapshot"), "book_id", "left")
    parts = (F.coalesce("snapshot", F.lit("-")), F.col("before_text"), F.coalesce("source", F.lit("")), F.col("after_text"))
    return joined.select("chunk_key", hashing.hash_joined(*parts).alias("packet_sha256"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p6_found, book_chunks, word_stats, source_inspection, normalized_pages, document_paragraphs, sentence_units, greedy_chunks, page_continuation,
        heading_flags, emphasis_parity, bracket_balance, english_residue, script_ratio, term_hits, alias_hits, proposal_conflicts, glossary_conflicts,
        glossary_conflicts_exact, term_candidates, new_terms, neighbor_context, transitions, assemble, marker_roundtrip, contiguity, latest_pages, chosen_target,
        hash_drift, chunk_drift, content_hashes, cache_misses, status_counts, usage_totals, claim_order, ready_tasks, downstream_closure, plan_tasks, plan_edges,
        invalidation_plan, publication_blocks, block_batches, batch_merge, remote_batches, run_pieces, inline_tokens, slugs, quality_issues, input_issues, gate_issues, registry_dump, context_packets,
    )
}
