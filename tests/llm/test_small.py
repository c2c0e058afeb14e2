"""Queries without SQL against plain Python over whole small tables, and the odd cases of each operator."""

import hashlib
import unicodedata
import zlib

import duckdb
import pytest
import xxhash

from quern.llm import exact_dedup, fingerprints, packing, token_files, tokens

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kind string"
ODD = [(1, None, "en", None, 0, "x"), (2, "", None, "a", 0, "y"), (3, "One two", "en", "a", 7, None), (3, "One two", "en", "a", 7, None), (4, "one  TWO ", "en", "b", 9, None), (5, " \t\n", "de", "b", 3, None), (None, "x" * 50_000 + " é", "fr", "c", 0, None)]


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"select doc_id, coalesce(text, '') from '{SF}/documents.parquet' order by doc_id").fetchall()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def ids_of(text):
    return tokens.encoder(tokens.default_path()).whole.encode(text, add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_token_files(spark, docs):
    start, want = 0, {}
    for i, t in docs:
        ids = [*ids_of(t), 2]
        want[i] = (start, len(ids), crc(ids))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.op3_token_files(spark, SF).collect()}
    assert got == want


def test_token_file_access(tmp_path):
    import numpy as np

    docs = [np.arange(n, dtype="<u2").tobytes() for n in (3, 0, 10, 5)]
    assert token_files.write_file(f"file://{tmp_path}/a/x.arrow", iter(docs), length=4, rows=2) == (5, 18)
    f = token_files.TokenFile(f"file://{tmp_path}/a/x.arrow")
    flat = [*range(3), *range(10), *range(5)]
    assert np.concatenate(list(f.ids(2, 13))).tolist() == flat[2:15]
    assert f.sequence(1).tolist() == flat[4:8] and f.sequence(4).tolist() == [3, 4, 0, 0]
    assert f.mask(4).tolist() == [True, True, False, False] and f.mask(0).all()


def test_packing(spark, docs):
    rows = packing.op7_packing(spark, SF).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    by = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {i for i, _ in docs}
    for i, t in docs:
        ids, at = [*ids_of(t), 1], 0
        for r in by[i]:
            assert (r.start, r.offset, r.doc_tokens) == (at, 0, len(ids))
            assert r.length <= 2048 and r.length & (r.length - 1) == 0 and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)


def test_buckets_of_one_length(spark, tmp_path):
    pieces = packing.pack(spark.read.parquet(f"{SF}/documents.parquet"))
    packing.write_buckets(pieces, f"file://{tmp_path}/buckets")
    back = spark.read.parquet(f"file://{tmp_path}/buckets").selectExpr("sequence_id", "length", "octet_length(ids) / 2 as n").collect()
    assert len(back) == pieces.count() and all(r.n == r.length for r in back)
    assert {p.name for p in (tmp_path / "buckets").iterdir() if p.is_dir()} == {f"length={r.length}" for r in back}


def test_fingerprints(spark, docs):
    def fp(t):
        return xxhash.xxh3_128_hexdigest(" ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()).split()).encode())

    order, want = docs[::-1], {}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        n = len(t) // 3
        e = t[: len(t) - n] + after[:n]
        want[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), fp(t), fp(e), float(fp(t) == fp(e)), float(fp(t) == fp(after)))
    for parts in ("8", "3", "1"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in fingerprints.op6_fingerprints(spark, SF).collect()}
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_canonical_groups(spark, odd):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.keep_id, r.group_size) for r in fingerprints.canonical_groups(odd).collect())
    assert got == [(False, 1, 1, 3), (False, 2, 1, 3), (False, 3, 3, 3), (False, 3, 3, 3), (False, 4, 3, 3), (False, 5, 1, 3), (True, 0, None, 1)]


def test_canonical_groups_tell_colliding_texts_apart(spark, odd):
    got = sorted((r.doc_id or 0, r.group_size) for r in fingerprints.canonical_groups(odd, digest=lambda b: "same").collect())
    assert got == [(0, 1), (1, 3), (2, 3), (3, 3), (3, 3), (4, 3), (5, 3)]


def test_fingerprints_come_with_groups(spark):
    rows = fingerprints.op6_fingerprints(spark, SF).collect()
    groups = {}
    for i, t in duckdb.sql(f"select doc_id, coalesce(text, '') from '{SF}/documents.parquet'").fetchall():
        groups.setdefault(fingerprints.canonical(t), []).append(i)
    want = {i: (min(g), len(g)) for g in groups.values() for i in g}
    assert max(n for _, n in want.values()) > 1
    assert {r.doc_id: (r.keep_id, r.group_size) for r in rows} == want


def test_groups_beside_the_next(spark, odd, monkeypatch):
    for digest in (fingerprints.xxh3_128_hexdigest, lambda b: "same"):
        for most in (1_000_000, 0):
            monkeypatch.setattr(fingerprints, "BROADCAST_ROWS", most)
            got = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size) for r in fingerprints.with_groups(odd, digest).collect())
            assert got == sorted((r.doc_id or 0, r.keep_id or 0, r.group_size) for r in fingerprints.canonical_groups(odd, digest).collect())
    assert fingerprints.with_groups(odd.limit(0)).collect() == []


def test_polynomials_combine():
    data = bytes(range(256)) * 200
    for cut in (0, 1, 16_384, 20_000):
        a, b = data[:cut][-16_384:], data[cut : cut + 100]
        whole = exact_dedup.fingerprint(a + b)
        h = exact_dedup.combine(exact_dedup.chunk_hash(a), exact_dedup.chunk_hash(b), len(b))
        assert whole == (h[0] << 31 | h[1])
    slow = 0
    for x in data:
        slow = (slow * exact_dedup.BASES[0] + x) % exact_dedup.PRIMES[0]
    assert exact_dedup.fingerprint(data) >> 31 == slow


def test_huge_texts_are_hashed_in_parallel(spark, odd, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    want = sorted(map(str, exact_dedup.fingerprints(docs).collect()))
    groups = sorted(map(str, exact_dedup.exact_duplicates(docs).collect()))
    monkeypatch.setattr(exact_dedup, "HUGE", 5)
    monkeypatch.setattr(exact_dedup, "PIECE", 1000)
    assert sorted(map(str, exact_dedup.fingerprints(docs).collect())) == want
    assert sorted(map(str, exact_dedup.exact_duplicates(docs).collect())) == groups


def test_exact_dedup_with_equal_fingerprints(spark, odd, monkeypatch):
    rows = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(odd).collect()}
    assert rows == {(1, 1, 2, True), (2, 1, 2, False), (3, 3, 2, True), (4, 4, 1, True), (5, 5, 1, True), (None, None, 1, True)}
    real = exact_dedup.fingerprints
    monkeypatch.setattr(exact_dedup, "fingerprints", lambda d: real(d).selectExpr("doc_id", "7L as fp", "1L as n_bytes", "text_sha256"))
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(odd).collect()} == rows


def test_empty_and_odd_tables(spark, odd):
    none = spark.createDataFrame([], SCHEMA)
    for f in (token_files.encode_to_files, packing.pack, fingerprints.with_next, fingerprints.canonical_groups, exact_dedup.exact_duplicates):
        assert f(none).collect() == []
    assert token_files.read_digests(token_files.encode_to_files(odd)).count() == 7
    assert {r.doc_id for r in packing.pack(odd).collect()} == {1, 2, 3, 4, 5, None}
    assert fingerprints.with_next(odd).count() == 7
