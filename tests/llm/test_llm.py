"""The training-data operators against brute force, exact round trips and held-out labels, on small tables."""

import base64
import collections
import hashlib
import io
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

import corpus_pipeline
from clusterlens.llm import (
    exact_dedup,
    line_quality,
    mixing,
    near_dedup,
    pieces,
    queries,
    repeats,
    token_files,
    toxicity,
    urls,
    warc,
    words,
)
from clusterlens.llm.shared import Scratch, table

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, h long, sha string, c long, key long, v long"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")


def documents(spark, rows):
    """Documents (id, text, source) with more columns whose names the operators use themselves."""
    full = [(d, t, None, s, None, 1, 2, "x", 3, 4, 5) for d, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def odd_docs(spark):
    rng = random.Random(5)
    base = [prose(rng, 120) for _ in range(12)]
    shared = prose(rng, 60)
    rows = [(i, t, "a" if i % 3 else "b") for i, t in enumerate(base)]
    rows += [(20, base[0], None), (21, base[0], "c"), (21, base[0], "c"), (22, None, "a"), (23, "", "b"), (24, " \n\t", "b")]
    rows += [(30, base[1].replace("a", "b", 1), "a"), (31, shared + " " + base[2], "a"), (32, base[3] + "\n" + shared, "b")]
    rows += [(33, ("<|endoftext|> 's ,. ▁▁ é. \u3000x " * 9) + "😀" * 40, "d"), (None, base[4], "a"), (None, None, None)]
    rows += [(40, "x" * 50_000, "d"), (41, ("w " * 30_000), "d"), (42, "one two three", "a")]
    return rows


def test_words_are_those_of_the_definition():
    texts = ["a\x0bb\x1cc\x85d", None, "", "é\u3000f g", " \n"]
    w = words.split(pa.array(texts))
    got = [bytes(w.data[a:b]) for a, b in zip(w.start, w.end)]
    assert got == [x for t in texts for x in (t or "").encode().split()]
    assert np.diff(w.first).tolist() == [2, 0, 0, 2, 0]
    assert len(set(w.hashes().tolist())) == len(set(got))


def test_mix_meets_targets(spark, odd_docs):
    docs = documents(spark, odd_docs)
    got = mixing.summary(spark, docs).collect()
    assert len(got) == len(odd_docs)
    total = sum(r.size for r in got)
    assert total == sum(len((t or "").encode().split()) for _, t, _ in odd_docs)
    by = collections.defaultdict(list)
    for r in got:
        assert r.taken <= 2 * r.size
        by[r.source_size, r.target].append(r)
    assert sum(t for _, t in by) == pytest.approx(1.5 * total)
    for (size, target), rows in by.items():
        assert target <= 2 * size and abs(sum(r.taken for r in rows) - target) <= max(r.size for r in rows)
    assert sorted(got, key=str) == sorted(mixing.summary(spark, docs).collect(), key=str)
    small = mixing.mix(spark, docs, share=0.4).groupBy("doc_id", "text").count()
    large = mixing.mix(spark, docs, share=0.9).groupBy("doc_id", "text").count().withColumnRenamed("count", "more")
    joined = small.join(large, small["doc_id"].eqNullSafe(large["doc_id"]) & small["text"].eqNullSafe(large["text"]), "left")
    assert joined.where("more is null or more < count").isEmpty()
    assert mixing.mix(spark, docs).columns == docs.columns


def test_url_rules_and_terms(spark):
    rows = [
        (1, "HTTP://WWW.Example.COM/en/x?q", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        (2, "http://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
        (3, "x://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        (4, "x://example.com", "example.com", "", None, "allow"),
        (5, "http://x.net/fr/#a", "x.net", "/fr/", "net/fr/", "block"),
        (6, "http://x.org/porn", "x.org", "/porn", None, "block"),
        (7, "http://x.org/pornography", "x.org", "/pornography", None, "allow"),
        (8, "http://ads.x.org/ads", "ads.x.org", "/ads", None, "allow"),
        (9, "http://ads-track.x.org", "ads-track.x.org", "", None, "block"),
        (10, None, "", "", None, "allow"),
        (11, "example.com/en/", "", "", None, "allow"),
        (12, "", "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(r[0], r[1], "h", "p") for r in rows], "page_id long, url string, host string, _html string")
    got = urls.judge(pages).select("page_id", "host", "path", "rule", "verdict").orderBy("page_id").collect()
    assert [tuple(r) for r in got] == [(r[0], *r[2:]) for r in rows]
    assert urls.judge(pages.limit(0)).count() == 0


SPAM = "adult-x free-bets spam-farm cheap-pills ads-track casino-win best-casinos erotica-club payday-loans hentai-tube cheap-meds link-farms".split()
PLAIN = "essex middlesex-news adultery-law winter-tracks free-software download-manual better-life credit-union saddle scunthorpe-times".split()


def test_spam_hosts_are_found_where_no_rule_decides(spark):
    urls_of = [(f"https://{w}{h}.example.{top}/{path}/12.html", h) for top, path in (("net", "de"), ("net", "en"), ("org", "fr")) for h in SPAM + PLAIN for w in ("", "www.", "blog.")]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls_of)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages).collect()}
    assert [(u, *got[i]) for i, (u, h) in enumerate(urls_of) if got[i] != (None, "block" if h in SPAM else "allow")] == []


def test_terms_fit_the_sql_form():
    terms = [*urls.STRICT, *urls.SOFT]
    assert len(set(terms)) == len(terms)
    assert all(set(t) <= set("abcdefghijklmnopqrstuvwxyz-") and t.strip("-") == t for t in terms)


def test_token_files_round_trip(spark, odd_docs, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    docs = documents(spark, odd_docs)
    got = token_files.round_trip(spark, docs, path, shard_bytes=2000).collect()
    want, at = [], 0
    order = sorted(odd_docs, key=lambda r: (r[0] is not None, r[0] or 0))
    for d, t, _ in order:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got)
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    scratch = Scratch(spark, "test-ids")
    shards, dictionary = token_files.write(spark, docs, path, scratch)
    raw = token_files.read_dictionary(dictionary)
    for shard in shards.collect():
        reader = token_files.Reader(shard.path, raw)
        for row in reader.index:
            if row["has_id"] and row["doc_id"] == 33:
                text = next(t for d, t, _ in odd_docs if d == 33)
                assert reader.find(33).tolist() == [*plain.encode(text, add_special_tokens=False).ids, 0]
        reader.close()
        with pytest.raises(ValueError):
            token_files.Reader(shard.path, raw + b"x")
    assert token_files.round_trip(spark, docs.limit(0), path).count() == 0


def test_dictionary_knows_late_parts_and_small_sources(spark):
    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(8)
    late = [" ".join(rng.choice("river stone amber velvet harvest lantern orchard thunder".split()) for _ in range(30)) for _ in range(40)]
    body = lambda: " ".join(rng.choice(late) for _ in range(60))
    rows = [(i, prose(rng, 2500) + " " + body(), "a") for i in range(120)]
    raw = token_files.train_dictionary(documents(spark, rows), path)
    ids = token_files.pack(np.frombuffer(token_files.encoder(path).encode([" ".join(late[:20])])[0], "<u4"))
    sizes = [len(token_files._compressor(d).compress(ids)) for d in (b"", raw)]
    assert sizes[1] < 0.5 * sizes[0], sizes
    rows = [(i, f"text {i}", "a") for i in range(5000)] + [(None, f"none {i}" * i, None) for i in range(1, 6)] + [(9000, "few", "b")]
    got = [r.text for r in token_files.sample(documents(spark, rows)).collect()]
    assert len(got) == token_files.SAMPLE_DOCS and {r[1] for r in rows[5000:]} <= set(got)
    assert token_files.shares({1: 5, 2: 900, 3: 900}, 1000) == {1: 5, 2: 497, 3: 498}


def test_pieces_of_odd_texts():
    encoder = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    model_path = public_tokenizers.path("piece_bpe_32k.model")
    model, chunks = sentencepiece.SentencePieceProcessor(model_file=model_path), pieces.Pieces(model_path)
    assert chunks.by_words
    parts = [" ", "  ", "\n", "\t", "a", "Foo", "'s", "'", "é", "▁", "<s>", "\u3000", "\x85", "\x1c", "12", ".", ",", "!!", "日本", "<|endoftext|>", "😀", "\x00", "\u0301", "×", "É"]
    rng = random.Random(1)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    for text, raw, ids in zip(texts, encoder.encode(texts), chunks.encode(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert ids == model.encode(text)


def test_pieces_digests(spark, odd_docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = documents(spark, odd_docs)
    want = []
    for d, t, _ in odd_docs:
        ids = model.encode(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in pieces.digests(docs, path).collect())
    again = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs, path), path).collect()}
    assert again[0] == odd_docs[0][1] and again[23] == ""
    assert pieces.digests(docs.limit(0), path).count() == 0


def test_warc_round_trip(spark):
    rows = [(1, "http://a b", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 70_000), (None, "u", "x"), (7, "u", "y\r\n\r\nWARC/1.1\r\n"), (7, "u", "z")]
    pages = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, sha string")
    got = warc.round_trip(spark, pages, archive_bytes=400).collect()
    want = []
    for page, _, html in rows:
        first = max(p for p, _, h in rows if (h or "") == (html or "") and p is not None)
        raw = (html or "").encode()
        again = page != first
        want.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first if again else None))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def _archive(plain=False):
    parts = []
    for i in range(6):
        raw = warc.record_bytes(i, f"http://x/{i}", (f"page {i} " * 2000).encode(), None)
        press = zlib.compressobj(2, zlib.DEFLATED, 31)
        parts.append(raw if plain else press.compress(raw) + press.flush())
    return parts


@pytest.mark.parametrize("plain", [False, True])
@pytest.mark.parametrize("harm", ["flip", "cut", "junk", "tail"])
def test_salvage_logs_the_gap(plain, harm):
    parts = _archive(plain)
    at = sum(map(len, parts[:2]))
    if harm == "flip":
        middle = len(parts[2]) // 2
        parts[2] = parts[2][:middle] + bytes([parts[2][middle] ^ 0x55]) + parts[2][middle + 1 :]
        gap, lost = (at, at + len(parts[2])), {2}
    elif harm == "cut":
        parts[2] = parts[2][: len(parts[2]) // 2] + (b"\n" if plain else b"")
        gap, lost = (at, at + len(parts[2])), {2}
    elif harm == "junk":
        parts.insert(2, b"\x1f\x8b\x08 no member \nWARC/1.1\r\nbroken\r\n")
        gap, lost = (at, at + len(parts[2])), set()
    else:
        parts[5] = parts[5][:-30]
        gap, lost = (sum(map(len, parts[:5])), sum(map(len, parts))), {5}
    got = list(warc.salvage(io.BytesIO(b"".join(parts))))
    assert [int(r.headers["WARC-Record-ID"][len("<urn:page:") : -1]) for *_, r in got if r] == [i for i in range(6) if i not in lost]
    assert [(s, e) for s, e, reason, _ in got if reason] == [gap]


@pytest.mark.parametrize("plain", [False, True])
@pytest.mark.parametrize("inside", [b"", warc.MAGIC + b"\0 no member"])
@pytest.mark.parametrize("size", [100, 70_000, 300_000])
def test_salvage_of_a_damaged_first_record(plain, inside, size):
    parts = _archive(plain)
    noise = random.Random(size).randbytes(size)
    raw = warc.record_bytes(9, "http://x/9", noise[: size // 2] + inside + noise[size // 2 :], None)
    press = zlib.compressobj(2, zlib.DEFLATED, 31)
    first = raw if plain else press.compress(raw) + press.flush()
    first = b"X" + first[1:]
    got = list(warc.salvage(io.BytesIO(b"".join([first, *parts]))))
    assert [(s, e) for s, e, reason, _ in got if reason] == [(0, len(first))]
    assert [int(r.headers["WARC-Record-ID"][len("<urn:page:") : -1]) for *_, r in got if r] == list(range(6))


def test_salvage_finds_starts_at_every_offset_of_a_chunk():
    one, two = _archive(True)[0], _archive(False)[1]
    for n in [*range(warc.CHUNK - 14, warc.CHUNK + 3), *range(2 * warc.CHUNK - 14, 2 * warc.CHUNK + 3)]:
        for part in (one, two):
            got = list(warc.salvage(io.BytesIO(b"x" * (n - 1) + b"\n" + part + two)))
            assert [(s, e, r is None) for s, e, _, r in got] == [(0, n, True), (n, n + len(part), False), (n + len(part), n + len(part) + len(two), False)]


def test_round_trip_raises_on_a_gap(spark, monkeypatch):
    def damaged(*a, write=warc.write):
        files = write(*a)
        path = files.first().path.removeprefix("file://")
        with open(path, "r+b") as file:
            file.seek(os.path.getsize(path) // 2)
            byte = file.read(1)[0]
            file.seek(-1, 1)
            file.write(bytes([byte ^ 0x55]))
        return files

    pages = spark.createDataFrame([(i, "u", f"page {i} " * 200) for i in range(5)], "page_id long, url string, html string")
    assert warc.round_trip(spark, pages).count() == 5
    monkeypatch.setattr(warc, "write", damaged)
    with pytest.raises(Exception, match="gap in .* from"):
        warc.round_trip(spark, pages).collect()


def brute_figures(text):
    found = text.encode().split()
    lines = [x for x in text.split("\n") if x.encode().split()]
    grams = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
    counts = collections.Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(3)}
    return (len(found), sum(len(w.decode()) for w in found), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


@needs_tables
def test_line_quality_figures(spark, odd_docs):
    rows = [*odd_docs, (50, "a b\n a b\na b\r\na b\n\n##$ |x|<>\na b", "a")]
    labels = table(spark, SMALL, "labels")
    got = line_quality.judge(spark, documents(spark, rows), labels).collect()
    want = sorted(str((d, *brute_figures(t or ""))) for d, t, _ in rows)
    assert sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


@needs_tables
def test_line_quality_on_held_out_labels(spark):
    docs, labels = table(spark, SMALL.replace("0.001", "0.01"), "documents"), table(spark, SMALL.replace("0.001", "0.01"), "labels")
    got = line_quality.judge(spark, docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in got]) > 0.95
    assert np.mean([r.kept for r in got if r.quality == 1]) > 0.98


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    for _ in range(20):
        score, moves = rng.normal(size=(6, 2)), rng.normal(size=(2, 2))
        paths = [[(p >> i) & 1 for i in range(6)] for p in range(64)]
        worth = [sum(score[i, x] for i, x in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:])) for p in paths]
        assert line_quality.viterbi(score, moves).tolist() == paths[int(np.argmax(worth))]


def test_exact_groups(spark, odd_docs):
    docs = documents(spark, odd_docs)
    got = exact_dedup.groups(spark, docs, capacity=64).collect()
    by = collections.defaultdict(list)
    for d, t, _ in odd_docs:
        by[t or ""].append(d)
    for r in got:
        text = next(t for t in by if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(by[text]) and r.keep_id == max((d for d in by[text] if d is not None), default=None)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, *_ in odd_docs)
    assert collections.Counter(r.text_sha256 for r in got if r.kept) == {hashlib.sha256(t.encode()).hexdigest(): 1 for t in by}
    kept = exact_dedup.deduplicate(spark, docs)
    assert kept.columns == docs.columns and sorted(r.text or "" for r in kept.collect()) == sorted(by)
    assert exact_dedup.groups(spark, docs.limit(0)).count() == 0


def test_directory_splits_overfull_buckets(spark):
    rows = [(i * 0x9E3779B97F4A7C15 % (1 << 63), 10) for i in range(1, 500)] + [(5, 10_000)]
    buckets = exact_dedup.directory(spark, spark.createDataFrame(rows, "h long, bytes long"), 200)
    starts = [p << (64 - d) for p, d in buckets]
    assert starts[0] == 0 and all(a + (1 << (64 - d)) == b for a, (_, d), b in zip(starts, buckets, [*starts[1:], 1 << 64]))
    for (p, d), start in zip(buckets, starts):
        held = sum(n for h, n in rows if start <= h < start + (1 << (64 - d)))
        assert held <= 200 or d == exact_dedup.DEEPEST


def test_collisions_are_chained():
    rows = pa.RecordBatch.from_pylist(
        [{"bucket": 0, "h": 7, "sha": s, "text": t, "keep_id": d, "n_best": 1, "n": 2} for s, t, d in [(b"1", "x", 3), (b"2", "y", 5), (b"1", "x", 9)]],
        schema=exact_dedup._FOLDED,
    )
    got = [r for b in exact_dedup._own([rows]) for r in b.to_pylist()]
    assert [(r["chain"], r["keep_id"], r["group_size"]) for r in got] == [(0, 9, 4), (1, 5, 2)]


def test_near_classes_against_all_pairs(spark):
    rng = random.Random(9)
    rows = []
    for i in range(25):
        base = prose(rng, 150).split()
        rows.append((i * 10, " ".join(base), "a"))
        for k in range(1, 5):
            changed = list(base)
            for _ in range(k):
                changed[rng.randrange(150)] = "zz" + str(rng.random())
            rows.append((i * 10 + k, " ".join(changed), "a"))
    rows += [(900, rows[0][1], "a"), (901, None, "a"), (902, "", "a"), (903, "one two three", "a"), (None, rows[5][1], "a"), (904, "x " * 30_000, "a")]
    docs = documents(spark, rows)
    got = {(r.doc_id, r.text_sha256): r for r in near_dedup.classes(spark, docs).collect()}
    assert len(got) == len(rows)
    idf = near_dedup.frequencies(docs)
    texts = [t or "" for _, t, _ in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        j = near_dedup.similarities(pa.array([texts[i]] * len(rows)), pa.array(texts), idf)
        for k in range(i):
            if j[k] >= near_dedup.LEAST or texts[i] == texts[k]:
                label[root(i)] = root(k)
    members = collections.defaultdict(list)
    for i, (d, _, _) in enumerate(rows):
        members[root(i)].append(d)
    for i, (d, t, _) in enumerate(rows):
        r = got[d, hashlib.sha256(texts[i].encode()).hexdigest()]
        assert r.class_id == min(x for x in members[root(i)] if x is not None) and r.class_size == len(members[root(i)])
    assert sum(r.kept for r in got.values()) == len(members)
    kept = near_dedup.deduplicate(spark, docs)
    assert kept.columns == docs.columns and kept.count() == len(members)
    assert near_dedup.classes(spark, docs.limit(0)).count() == 0


def test_samples_agree_as_often_as_texts_are_alike():
    rng = random.Random(3)
    a = prose(rng, 400).split()
    b = a[:360] + prose(rng, 40).split()
    table_ = np.ones(near_dedup.COUNTERS)
    t, g, n = near_dedup.shingles(pa.array([" ".join(a), " ".join(b)]))
    _, drawn = near_dedup.samples(t, g, n.astype(float), near_dedup._SEEDS[:600])
    j = near_dedup.similarities(pa.array([" ".join(a)]), pa.array([" ".join(b)]), table_)[0]
    assert abs((drawn[0] == drawn[1]).mean() - j) < 0.07


def brute_repeats(rows):
    seen, out = set(), {}
    for d, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        found = (t or "").encode().split()
        gone = set()
        for i in range(len(found) - 19):
            key = tuple(found[i : i + 20])
            if key in seen:
                gone.update(range(i, i + 20))
            seen.add(key)
        out[d] = (len(found), len(gone), hashlib.sha256(b" ".join(w for i, w in enumerate(found) if i not in gone)).hexdigest())
    return out


@pytest.mark.parametrize("crowd", [0, 3, 4096])
def test_repeats_against_brute_force(spark, odd_docs, crowd):
    rng = random.Random(11)
    few = ["a", "b", "c"]
    rows = [r for r in odd_docs if r[0] not in (21, None)] + [(21, odd_docs[0][1], "c"), (None, odd_docs[5][1], "a")]
    passage = prose(rng, 45)
    rows += [(100 + i, prose(rng, 15) + ("\n" if i % 2 else " ") + passage + "  " + prose(rng, 15), "p") for i in range(12)]
    rows += [(200 + i, " ".join(rng.choice(few) for _ in range(200)), "q") for i in range(4)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.remove(spark, documents(spark, rows), crowd).collect()}
    assert got == brute_repeats(rows)


def test_repeats_of_repeated_rows_and_nothing(spark, odd_docs):
    twice = documents(spark, [odd_docs[0], odd_docs[0]])
    assert [r.n_removed for r in repeats.remove(spark, twice).collect()] == [0, 0]
    assert repeats.remove(spark, twice.limit(0)).count() == 0


@needs_tables
def test_toxicity_on_held_out_labels(spark):
    big = SMALL.replace("0.001", "0.01")
    docs, labels = table(spark, big, "documents"), table(spark, big, "labels")
    model = toxicity.fit(spark, docs, labels.where("doc_id % 4 > 0"))
    got = toxicity.score(docs, model).join(labels.where("doc_id % 4 = 0").withColumnRenamed("toxic", "told"), "doc_id").collect()
    assert np.mean([r.toxic == (r.told == 1) for r in got]) > 0.93
    assert np.mean([r.toxic for r in got if r.told == 0]) < 0.03


@needs_tables
def test_toxicity_of_odd_rows(spark, odd_docs):
    model = toxicity.fit(spark, table(spark, SMALL, "documents"), table(spark, SMALL, "labels"))
    got = toxicity.score(documents(spark, odd_docs), model).collect()
    assert len(got) == len(odd_docs) and not any(r.toxic for r in got if r.doc_id in (22, 23, 24))
    none = toxicity.fit(spark, table(spark, SMALL, "documents"), table(spark, SMALL, "labels").limit(0))
    assert toxicity.score(documents(spark, odd_docs), none).where("toxic").isEmpty()


def test_chain_trains_on_out_of_fold_predictions():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3))
    y = np.stack([x[:, 0] > 0, (x[:, 0] > 0) & (x[:, 1] > 0)], axis=1).astype(float)
    fold = np.arange(200) % toxicity.FOLDS
    weights, early = toxicity.fit_chain(x, y, fold)
    assert [len(w) for w in weights] == [4, 5]
    assert ((early[:, 0] > 0.5) == y[:, 0]).mean() > 0.9
    other = y.copy()
    other[fold == 0] = 1 - other[fold == 0]  # a fold's own labels have no part in its predictions
    assert np.allclose(toxicity.fit_chain(x, other, fold)[1][fold == 0, 0], early[fold == 0, 0])


@needs_tables
def test_pipeline_stages(spark):
    docs = table(spark, SMALL, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = corpus_pipeline.quality(spark, docs, SMALL)
    kept = {r.doc_id for r in line_quality.judge(spark, docs, table(spark, SMALL, "labels")).where("kept").collect()}
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == kept
    exact = corpus_pipeline.exact(spark, good, SMALL)
    latest = {texts[d]: d for d in sorted(kept)}
    assert {r.doc_id for r in exact.collect()} == set(latest.values())
    near = corpus_pipeline.near(spark, exact, SMALL)
    classes = near_dedup.classes(spark, exact).collect()
    assert {r.doc_id for r in near.collect()} == {r.class_id for r in classes}
    mixed = corpus_pipeline.mixture(spark, near, SMALL)
    plan = {r.doc_id: r.taken // max(r.size, 1) for r in mixing.summary(spark, near).collect()}
    assert collections.Counter(r.doc_id for r in mixed.collect()) == {d: n for d, n in plan.items() if n}
    last = corpus_pipeline.run(spark, SMALL)
    assert last.count() == mixed.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "mix", "pieces"]


def all_pairs_classes(texts):
    """The least id of each text's class: weighted Jaccard of all pairs in plain Python, with counted document frequencies."""
    found = {d: re.findall(r"[^\x20\x09-\x0D]+", t) for d, t in texts.items()}
    grams = {d: collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for d, w in found.items()}
    df, n = collections.Counter(g for c in grams.values() for g in c), len(texts)
    idf = {g: 1 + near_dedup.DAMPING * math.log((n + 1) / (k + 1)) / math.log(n + 2) for g, k in df.items()}
    total = {d: sum(m * idf[g] for g, m in c.items()) for d, c in grams.items()}
    label = {d: d for d in texts}
    for a in sorted(texts):
        for b in sorted(x for x in texts if x < a):
            if min(total[a], total[b]) >= 0.8 * max(total[a], total[b]) > 0:
                common = sum(min(m, grams[b][g]) * idf[g] for g, m in grams[a].items() if g in grams[b])
                if common >= 0.8 * (total[a] + total[b] - common):
                    low, high = sorted((label[a], label[b]))
                    label = {d: low if c == high else c for d, c in label.items()}
    return label


@needs_tables
def test_pipeline_rows_against_independent_computation(spark):
    docs = table(spark, SMALL, "documents")
    good = corpus_pipeline.quality(spark, docs, SMALL).select("doc_id", "text", "source").collect()
    last = {r.text: r for r in sorted(good, key=lambda r: r.doc_id)}
    exact = {r.doc_id: r for r in last.values()}
    classes = all_pairs_classes({d: r.text for d, r in exact.items()})
    assert 1 < len(set(classes.values())) < len(classes)
    documents = pd.DataFrame([exact[d].asDict() for d in sorted(set(classes.values()))])  # noqa: F841  the SQL reads it
    plan = duckdb.sql(queries.ORACLES["op1_mixing"]).fetchall()
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.PIECES))
    want = []
    for d, size, _, _, taken in plan:
        ids = model.encode(exact[d].text)
        digests = (hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), model.decode(ids)))
        want += [(d, len(ids), *digests)] * (taken // max(size, 1))
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SMALL).collect()) == sorted(want)


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.ORACLES) <= set(queries.QUERIES)
