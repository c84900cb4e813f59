"""Conversation repair, filter audit and nearest neighbours against brute force, on small tables."""

import collections
import hashlib
import heapq
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from clusterlens.llm import conversations, filter_audit, neighbours

WHITE = " \t\n\x0b\x0c\r"
TALK = "conv_id long, turn long, role string, text string, chunk long, link long, i int, left_ string, tie long"


def talks(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "x", 4) for r in rows], TALK).repartition(3)


def repaired(rows):
    """Least edits by Dijkstra over (row, state) with keys (cost, audit)."""
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        draw = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if draw == 1 else re.sub("[.!?]", "", x) if draw == 2 else x
        by[c] += [(t, "user" if draw == 4 else r, x)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    return {c: least(rs) for c, rs in by.items()}


def least(rs):
    def digest(r, x):
        return hashlib.sha256(f"{r}:{x}:{len(r)}".encode()).digest()

    rs = sorted(rs, key=lambda z: (z[0] is not None, z[0] or 0, z[1], digest(z[1], z[2])))
    faults, seen = [], set()
    for _, r, x in rs:
        bare = x.strip(WHITE)
        faults.append("b" if not bare else "d" if (r, x) in seen else "." if bare[-1] in ".!?" else "t")
        seen.add((r, x))
    turns = [t for t, _, _ in rs if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rs, rs[1:]))
    to = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, path = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rs) and state in ("", "a"):
            break
        steps = [(2, "I", 0, z, (names[z] + ":",)) for z in "ua" if z in to[state]]
        if i < len(rs):
            _, r, x = rs[i]
            steps.append((3, "D", 1, None, ()))
            if faults[i] in ".t":
                more = faults[i] == "t"
                steps += [(more, "K", 1, r[:1], (f"{r}:{x}",))] if r[:1] and r[:1] in to[state] else []
                steps += [(2 + more, "R", 1, z, (f"{names[z]}:{x}",)) for z in "ua" if z in to[state]]
        for c, letter, on, z, out in steps:
            heapq.heappush(heap, (cost + c, audit + letter, i + on, state if z is None else to[state][z], path + out))
    counts = [faults.count(f) for f in "bdt"]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(path).encode()).hexdigest())


def odd_talks():
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "tool", "", None, "ux"]
    texts = ["Yes.", "No!", "so", "", None, " \n", "What? ", "é.", "a\nb?"]
    rows = [(1, None, "user", "Hello."), (1, 5, "assistant", "x"), (2, None, None, None), (None, 1, "user", "Hi."), (None, None, "assistant", "Ho.")]
    for c in range(10, 60):
        for t in range(rng.randint(1, 12)):
            rows.append((c, rng.choice([t, t, t + 3, None]), rng.choice(roles), rng.choice(texts) and f"{rng.choice(texts)}{rng.randint(0, 4)}."[rng.randint(0, 1) :]))
    for c, n in ((100, 300), (101, 300), (102, 300), (103, 300)):
        rows += [(c, t, {100: "user", 101: rng.choice(roles), 102: "tool", 103: "assistant" if t % 2 else "user"}[c], f"{t}.") for t in range(n)]
    rows += [(104, 7, "user", "Again.")] * 200 + [(105, t, "user", "Again.") for t in range(200)]
    rows += [(106, t, "assistant" if t % 2 else "user", "long " * 20_000 + f"{t}.") for t in range(4)]
    return rows


@pytest.mark.parametrize("chunk_rows", [1, 7, 1024])
def test_conversations_equal_dijkstra(spark, chunk_rows):
    rows = odd_talks()
    got = conversations.damage_and_repair(spark, talks(spark, rows), chunk_rows).collect()
    want = repaired(rows)
    assert len(got) == len(want)
    assert {r[0]: tuple(r)[1:] for r in got} == want


def test_conversations_that_lose_all_rows(spark):
    gone = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = conversations.damage_and_repair(spark, talks(spark, [(c, 0, "user", "Yes.") for c in gone])).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(tuple(r) for r in got) == [(c, 0, 0, 0, 0, 0, 0, "", empty) for c in gone]
    assert conversations.damage_and_repair(spark, talks(spark, [])).count() == 0


def test_bounds_hold_for_every_continuation():
    kinds = list(itertools.product(["s", "u", "a", ""], ["b", "t", "."]))
    for n in range(4):
        for row in itertools.product(kinds, repeat=n):
            v = conversations.backward([i for i, _ in row], [f for _, f in row], conversations.LAST)[0]
            assert all(v[s] <= conversations.BOUNDS[s][t] + v[t] for s in range(4) for t in range(4))


def audited(docs, labels):
    good, toxic = ({d for d, q, t in labels if d is not None and (q, t)[k] == 1} for k in (0, 1))
    rows = []
    for d, x, lang in docs:
        x = x or ""
        w = x.encode().split()
        f = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", x)) > 3 * len(x))
        f += "D" * bool(re.search("[#$%&*|]", x))
        f += "E" * any(d is not None and o is not None and o < d and (y or "") == x for o, y, _ in docs)
        rows.append((lang or "", f, d in good, d in toxic))
    out = {}
    orders = ["".join(p) for p in itertools.permutations("ABCDE")]
    for part in {r[0] for r in rows}:
        mine, shapley = [r for r in rows if r[0] == part], collections.Counter()
        for order in orders:
            for k, x in enumerate(order):
                left = [r for r in mine if not set(r[1]) & set(order[:k])]
                gone = [r for r in left if x in r[1]]
                fails = [r for r in mine if x in r[1]]
                shapley[x] += len(gone)
                lost = sum(r[2] for r in gone), sum(r[3] for r in gone)
                out[part, order, k + 1] = [len(left) - len(gone), len(gone), len(fails) - len(gone), sum(r[1] == x for r in mine), *lost]
        for order in orders:
            for k, x in enumerate(order):
                out[part, order, k + 1].append(shapley[x])
    return out


def test_filter_audit_equals_brute_force(spark):
    rng = random.Random(4)

    def text():
        n = rng.choice([3, 150, 250, 260])
        body = " ".join(rng.choice(["a", "b", "Cc", "dd"]) if rng.random() < 0.6 else str(rng.random()) for _ in range(n))
        return body + rng.choice(["", " #", "\n\x0b$", " É"])

    base = [text() for _ in range(12)]
    docs = [(i, rng.choice(base), rng.choice(["en", "fr", None, ""])) for i in range(80)]
    docs += [(None, base[0], "en"), (None, base[0], "fr"), (90, None, None), (91, "", "en"), (90, None, None), (5, docs[5][1], "fr"), (5, "x", "en")]
    docs += [(200 + i, "the same", "en") for i in range(50)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 80, 2)] + [(None, 1, 1), (4, 1, 1), (4, 0, 0)]
    schema = "doc_id long, text string, lang string, bits long, h string, salt long, part string, n long"
    table = spark.createDataFrame([(*d, 1, "x", 2, "y", 3) for d in docs], schema).repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(spark, table, marks).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert len(got) == 120 * 5 * 3
    assert {(r.part, r.filter_order, r.step): [r[c] for c in names] for r in got} == audited(docs, labels)
    assert filter_audit.audit(spark, table.limit(0), marks).count() == 0


def test_filter_audit_deals_a_crowd_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "SALT_ROWS", 10)
    docs = spark.createDataFrame([(i, "same" if i % 3 else str(i), "en") for i in range(300)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(spark, docs, labels).where("filter_order = 'EABCD' and step = 1").first()
    assert got.removed == 199 and got.kept == 101


def vectors(spark, rows):
    schema = "vec_id long, embedding array<float>, label int, v string, q string, ids long, size int"
    return spark.createDataFrame([(i, v, 0, "x", "y", 1, 2) for i, v in rows], schema).repartition(5)


def nearest(rows, every=50):
    """All pairs in double precision; rows that repeat id and vector once."""
    sound = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in sound:
        if i % every == 0:
            a = np.float64(np.float32(v))
            some = []
            for j, w in sound:
                if j != i and len(w) == len(v):
                    b = np.float64(np.float32(w))
                    some.append((float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))), j))
            out[i] = sorted(some, key=lambda x: (-x[0], x[1]))[:5]
    return out


def test_neighbours_of_few_vectors_are_exact(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 8)).astype(np.float32).tolist()
    rows = [(i * 5, v) for i, v in enumerate(base)]
    rows += [(1000 + i, base[3]) for i in range(200)]  # copies
    rows += [(2000 + i, [float(np.float32(x * 2)) for x in base[4]]) for i in range(3)]  # parallel
    rows += [(3000, None), (3050, []), (3100, [0.0] * 8), (3150, [None] + [1.0] * 7), (3200, [float("nan")] * 8), (None, base[5])]
    rows += [(3250, [float("inf")] + [1.0] * 7), (3300, [1.0, 2.0]), (3350, [2.0, 1.0]), (3400, base[6]), (3400, base[6]), (3450, [1.0, 2.0, 3.0])]
    got = collections.defaultdict(list)
    for r in sorted(neighbours.search(spark, vectors(spark, rows)).collect()):
        got[r.query_id].append((r.score, r.vec_id))
        assert r["rank"] == len(got[r.query_id])
    want = nearest(rows)
    want.pop(3450)  # alone of its length: no candidates, no rows
    assert set(got) == set(want)
    for q, rows_of in want.items():
        assert [i for _, i in got[q]] == [i for _, i in rows_of]
        assert [s for s, _ in got[q]] == pytest.approx([s for s, _ in rows_of], abs=1e-12)
    assert neighbours.search(spark, vectors(spark, [])).count() == 0


@pytest.mark.parametrize("n, blocks", [(3000, 64), (6000, 8192)])
def test_neighbours_recall(spark, monkeypatch, n, blocks):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", blocks)
    rng = np.random.default_rng(n)
    table = rng.normal(size=(n, 32)) + 2 * rng.normal(size=(20, 32))[rng.integers(20, size=n)]
    table[: n // 3] = table[0]  # a third of all rows is one vector
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(table)]
    got = collections.defaultdict(set)
    for r in neighbours.search(spark, vectors(spark, rows)).collect():
        got[r.query_id].add(r.vec_id)
    unit = table / np.linalg.norm(table, axis=1)[:, None]
    hits = total = 0
    for q in range(0, n, 50):
        score = (unit @ unit[q]).round(12)
        score[q] = -2
        best = np.lexsort((np.arange(n), -score))[:5]
        assert len(got[q]) == 5 and q not in got[q]
        hits, total = hits + len(got[q] & set(best.tolist())), total + 5
    assert hits / total >= 0.9


def test_forest_files_vectors_where_the_search_begins():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 16)).astype(np.float32)
    forest = neighbours.grow(x, 16)
    leaf, margins = forest.leaves(x), forest.margins(x)
    for k in range(0, 500, 25):
        found = forest.search(margins[k], 64)
        assert len(set(found)) == 64 == len(found)
        assert {(t, leaf[k, t]) for t in range(4)} == set(found[:4])
    assert np.bincount(leaf[:, 0]).max() < 2 * 500 / 16 + 8


def test_stages_keep_columns_of_any_name(spark):
    """Columns named as the operators name their own, in tables that are filtered, deduplicated and mixed."""
    from clusterlens.llm import exact_dedup, line_quality, mixing, near_dedup

    names = ["_times", "_copy", "_cut_source", "_cut_cut", "_text", "_digest", "_id", "_sha", "row", "times", "copy", "digest", "key", "sha", "stays", "a.b"]
    rng = random.Random(8)
    words = [" ".join("".join(rng.choice("abcdef") for _ in range(4)) for _ in range(120)) for _ in range(6)]
    rows = [(i, words[i % 6] if i % 3 else words[0], "a", *[f"{n}{i}" for n in names]) for i in range(18)]
    rows += [(99, None, None, *names), (99, None, None, *names)]
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(18)], "doc_id long, quality int, toxic int")
    whole = {str(r) for r in docs.collect()}
    for out in (line_quality.keep_good(spark, docs, labels), exact_dedup.deduplicate(spark, docs), near_dedup.deduplicate(spark, docs), mixing.mix(spark, docs)):
        assert out.columns == docs.columns
        assert {str(r) for r in out.collect()} <= whole
    kept = exact_dedup.deduplicate(spark, docs).collect()
    last = {t: max(r[0] for r in rows if r[1] == t) for t in {r[1] for r in rows}}
    assert sorted((r.doc_id, r.text is None) for r in kept) == sorted((d, t is None) for t, d in last.items())


def test_a_damaged_length_of_a_plain_archive_is_not_read_to_its_end(tmp_path):
    import io

    from clusterlens.llm import warc

    class Counting(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            out = super().read(n)
            self.taken += len(out)
            return out

    def record(i, length=None):
        block = b"x" * 50_000
        head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:{i}>\r\nContent-Length: {length or len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    records = [record(i) for i in range(200)]
    for damaged in (5_000_000, 10**12):
        archive = b"".join([records[0], record(1, damaged), *records[2:]])
        file = Counting(archive)
        found = list(warc.salvage(file))
        assert [f[2] is None for f in found] == [True, False, *[True] * 198]
        assert found[1][:2] == (len(records[0]), len(archive) - sum(map(len, records[2:])))
        assert file.taken < 3 * len(archive)


def test_kinds_of_toxic_documents_are_groups_of_the_sample():
    from clusterlens.llm import toxicity

    rng = np.random.default_rng(3)
    x = np.zeros((90, 8))
    x[:60, :4], x[60:, 4:] = rng.random((60, 4)) + 0.2, rng.random((30, 4)) + 0.2
    assert toxicity.kinds_of(x).tolist() == [0] * 60 + [1] * 30
    assert toxicity.kinds_of(x[:1]).tolist() == [0] and toxicity.kinds_of(x[:0]).tolist() == []
    assert set(toxicity.kinds_of(np.ones((5, 3))).tolist()) == {0}
