from pyspark.sql import functions as F

from inkloom.llm.copies import Ledger, bucket_count, by_arrival, compose, copies_of, joined_fields, keyed, ledger_of, letters_and_digits, record_key


def key_of(spark, *texts):
    df = compose(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string"), "t")
    return [r["k"] for r in df.select("i", letters_and_digits(F.col("t")).alias("k")).orderBy("i").collect()]


def test_canonical_keys(spark):
    assert key_of(spark, "  Salt_Crossing:\n", "SALT-CROSSING", "salt crossing") == ["saltcrossing"] * 3
    a, b, c = key_of(spark, "Rév", "rév", "rev")
    assert a == b != c
    assert key_of(spark, None, "", "!?") == ["", "", ""]


def test_records(spark):
    same = [
        '{"source_term": "Ku-glo", "Category": "place", "notes": "near; the sea"}', "notes: NEAR; THE SEA|category: place|source_term: Ku-glo", "SOURCE TERM=ku glo;category=place.;Notes=near; the sea",
        'Source-Term: Ku-glo\nnotes: near; the sea\ncategory:  place', '{"source_term":"Ku-glo","category":"place","notes":"near; the sea","extra":null}',
    ]
    other = ['{"source_term": "place", "Category": "Ku-glo", "notes": "near; the sea"}', "source_term=Ku-glo;category=place", "plain text", '{"broken', "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(same + other)], "i long, t string")
    got = [r["k"] for r in df.select("i", record_key(F.col("t")).alias("k")).orderBy("i").collect()]
    assert len(set(got[: len(same)])) == 1
    assert got[0] not in got[len(same) :] and got[len(same) + 2] == "plaintext"


def rows_of(spark, data):
    df = spark.createDataFrame([(*d, "clash") for d in data], "id long, book long, t string, key string")
    return keyed(df, "terms", "id", "book", letters_and_digits(F.col("t")))


def test_ledger_over_batches_equals_one_batch(spark):
    data = [(i, i % 3, f"Term {i % 7}" if i % 2 else f"TERM-{i % 7}") for i in range(200)] + [(900 + i, 1, "hot") for i in range(100)] + [(5000, None, "x"), (5001, None, "x"), (5002, 1, None), (5003, 1, "--")]
    rows = rows_of(spark, data)
    whole = ledger_of(spark, [rows], buckets=4)
    parts = ledger_of(spark, [rows.filter(f"id % 3 = {i}") for i in (2, 0, 1)], buckets=4)
    assert sorted(whole.read().collect()) == sorted(parts.read().collect())
    want, first = [], {}
    for i, b, t in sorted(data):
        k = "".join(c for c in (t or "").lower() if c.isalnum())
        if b is not None and k:
            if (b, k) in first:
                want.append(("terms", first[(b, k)], i))
            first.setdefault((b, k), i)
    assert sorted(tuple(r) for r in copies_of(rows, parts).collect()) == sorted(want)


def test_untouched_buckets_are_carried_over_by_name(spark):
    ledger = ledger_of(spark, [rows_of(spark, [(i, 1, f"t{i}") for i in range(40)])], buckets=4)
    before = dict(ledger.paths)
    ledger.ingest(rows_of(spark, [(50, 1, "t1")]))
    assert sum(before[b] == p for b, p in ledger.paths.items()) == 3
    assert ledger.read().agg(F.sum("copies")).first()[0] == 41
    ledger.remove()
    assert ledger.read().count() == 0


def test_fields_are_kept_apart(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "abc"), ("abc", None)], "x string, y string")
    assert [r[0] for r in df.select(letters_and_digits(joined_fields("x", "y"), "\u0001")).collect()] == ["ab\u0001c", "a\u0001bc", "\u0001abc", "abc\u0001"]


def test_batches_by_arrival(spark):
    df = spark.createDataFrame([(1, 1, "a", "2026-01-01"), (2, 1, "A", "2026-01-09"), (3, 1, "a.", None), (4, 1, "b", "2026-01-02"), (5, 1, "B", "2026-01-08")], "id long, book long, t string, at string")
    rows = keyed(df, "terms", "id", "book", letters_and_digits(F.col("t")), "at")
    early, late = by_arrival(rows)
    assert sorted(r["id"] for r in early.collect()) == [1, 3, 4] and sorted(r["id"] for r in late.collect()) == [2, 5]
    assert sorted(tuple(r) for r in copies_of(rows, ledger_of(spark, [early, late], buckets=3)).collect()) == [("terms", 1, 2), ("terms", 1, 3), ("terms", 4, 5)]
    assert len(by_arrival(rows.filter("id = 3"))) == 1


def test_buckets_grow_with_the_rows():
    assert [bucket_count(n, 200) for n in (0, 10**5, 10**7, 10**9, 10**12)] == [1, 1, 100, 200, 100_000]


def test_empty_batches(spark):
    ledger = Ledger(spark, buckets=2)
    ledger.ingest(rows_of(spark, []))
    assert ledger.read().count() == 0 and copies_of(rows_of(spark, []), ledger).count() == 0
