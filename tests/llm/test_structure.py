"""Runs, conversation repair and repeated passages against plain Python."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from themescope.llm import passages, repair, runs
from themescope.llm.common import table
from themescope.llm.runindex import RunIndex

SF = "/root/testdata/sf0.001"
SPACE = r"[\x20\x09-\x0D]+"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- runs ------------------------------------------------------------------------

def plain_runs(w):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_planted(doc_id, text):
    w = [x for x in re.split(SPACE, text or "") if x]
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    return w


def plain_collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_of_random_words():
    rng = np.random.default_rng(7)
    for _ in range(150):
        docs = []
        for _ in range(rng.integers(1, 7)):
            n, k = int(rng.choice([0, 1, 12, 13, 60, 200])), int(rng.choice([1, 2, 3, 30]))
            w = rng.integers(0, k, n).tolist()
            if n > 20 and rng.random() < .6:
                a, p = int(rng.integers(0, n - 12)), int(rng.integers(1, 10))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            docs += [w] * int(rng.integers(1, 3))
        flat = np.array([x for d in docs for x in d], np.int64)
        got = [[] for _ in docs]
        for d, *r in zip(*(x.tolist() for x in runs.shard_runs(flat, np.array([len(d) for d in docs])))):
            got[d].append(tuple(r))
        assert got == [plain_runs(d) for d in docs]


def test_runs_survive_equal_hashes():
    """Thue-Morse words defeat polynomials modulo 2^64; they hold squares, no longer repetitions."""
    w = [0]
    for _ in range(12):
        w += [1 - x for x in w]
    got = [tuple(map(int, r)) for r in zip(*runs.shard_runs(np.array(w), np.array([len(w)]))[1:])]
    assert got == plain_runs(w)


def test_runs_of_awkward_rows(spark):
    line = "one two three four five six seven "
    data = [(1, None), (2, ""), (3, " \t\n "), (4, line * 5 + "end"), (4, line * 5 + "end"), (None, line * 2), (None, None),
            (5, "é ß " * 30), (6, "a " * 5000 + "b " * 5000), (7, "no run here"), (8, line * 3 + "x " + line * 3), (9, "x" * 100_000)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in data], "doc_id long, text string, runs string, n_words string").repartition(2)
    got = sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.periodic_runs(df, shard_words=60).collect())
    want = []
    for i, t in data:
        w = [x for x in re.split(SPACE, t or "") if x]
        want.append((i or 0, len(w), plain_runs(w), plain_collapsed(w, plain_runs(w))))
    assert got == sorted(want)
    assert runs.periodic_runs(df.limit(0)).collect() == []


def test_runs_query_equals_plain_search(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in runs.query(spark, SF).collect()}
    assert got.keys() == docs.keys()
    assert any(r.n_runs for r in got.values())
    for i, t in docs.items():
        w = plain_planted(i, t)
        found = plain_runs(w) if len(w) < 1500 else None
        r = got[i]
        if found is None:
            continue
        best = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *(best or (None,) * 3))
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == sha("".join("%d,%d,%d\n" % x for x in found))
        assert r.collapsed_sha256 == sha(plain_collapsed(w, found))


# --- conversation repair ------------------------------------------------------------

def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """Least (cost, audit) and the lines, by all prefixes: dynamic programme over whole audits."""
    best = {"0": (0, "", ())}                             # state -> (cost, audit, lines)

    def put(into, state, way):
        if state not in into or way[:2] < into[state][:2]:
            into[state] = way

    after = {"0": "user", "s": "user", "u": "assistant", "a": "user"}
    for (_, role, text), fault in zip(rows, plain_faults(rows)):
        new = {}
        for state, (cost, audit, lines) in best.items():
            for n in range(4):
                put(new, state, (cost + 3, audit + "D", lines))
                if fault not in ("blank", "duplicate"):
                    cut = fault == "truncated"
                    to = after[state]
                    put(new, to[0], (cost + 2 + cut, audit + "R", (*lines, f"{to}:{text}")))
                    if role[:1] == to[0] or role[:1] == "s" and state == "0":
                        put(new, role[0], (cost + cut, audit + "K", (*lines, f"{role}:{text}")))
                to = after[state]
                state, cost, audit, lines = to[0], cost + 2, audit + "I", (*lines, f"{to}:")
        best = new
    ends = []
    for state, (cost, audit, lines) in best.items():
        while state not in "0a":
            to = after[state]
            state, cost, audit, lines = to[0], cost + 2, audit + "I", (*lines, f"{to}:")
        ends.append((cost, audit, lines))
    return min(ends, key=lambda x: x[:2])


def plain_row(conv, rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults = plain_faults(rows)
    turns = [r[0] for r in rows if r[0] is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    cost, audit, lines = plain_repair(rows) if rows else (0, "", ())
    return (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha("\n".join(lines)))


def plain_damage(data):
    out = []
    for conv, turn, role, text in data:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d:
            row = (conv, turn, "user" if d == 4 else role, "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text)
            out += [row] * (2 if d == 3 else 1)
    return out


def brute_least(rows):
    """Every audit up to a length, by cost: for very short conversations only."""
    faults = plain_faults(rows)
    best = None

    def walk(i, state, cost, audit):
        nonlocal best
        if best is not None and cost > best[0] or len(audit) > 2 * len(rows) + 2:
            return
        if i == len(rows) and state in "0a" and (best is None or (cost, audit) < best):
            best = (cost, audit)
        to = "a" if state == "u" else "u"
        walk(i, to, cost + 2, audit + "I")
        if i < len(rows):
            walk(i + 1, state, cost + 3, audit + "D")
            if faults[i] not in ("blank", "duplicate"):
                cut = faults[i] == "truncated"
                walk(i + 1, to, cost + 2 + cut, audit + "R")
                first = rows[i][1][:1]
                if first == to or first == "s" and state == "0":
                    walk(i + 1, first, cost + cut, audit + "K")
    walk(0, "0", 0, "")
    return best


def test_repair_is_the_least_of_all_audits():
    rng = np.random.default_rng(3)
    for _ in range(250):
        rows = [(t, str(rng.choice(["system", "user", "assistant", "tool", ""])), str(rng.choice(["Yes.", "cut", " ", f"n{t}!"])))
                for t in range(rng.integers(0, 5))]
        assert plain_repair(rows)[:2] == brute_least(rows)
        code = {"": repair.SOUND, "blank": repair.LOST, "duplicate": repair.LOST, "truncated": repair.CUT}
        codes = bytes(repair.CLASSES.get(r[1][:1], repair.OTHER) + code[f] for r, f in zip(rows, plain_faults(rows)))
        if not codes:
            continue
        tables = [repair.row_table(c) for c in codes]
        end = repair.last_state(tables)
        cost, edits = repair.slice_edits(codes, repair.START, end)
        audit = "".join(e[0] for e in edits) + repair.ENDING[end]
        assert (cost + 2 * len(repair.ENDING[end]), audit) == brute_least(rows)
        for cut in range(1, len(codes)):                  # the same from two slices
            two = [repair.slice_table(codes[:cut]), repair.slice_table(codes[cut:])]
            assert repair.last_state(two) == end
            mid = repair.crossings(two, repair.START, end)[0]
            parts = repair.slice_edits(codes[:cut], repair.START, mid)[1] + repair.slice_edits(codes[cut:], mid, end)[1]
            assert parts == edits


@pytest.mark.parametrize("partitions", ["1", "8"])
def test_repair_of_awkward_conversations(spark, partitions):
    rng = np.random.default_rng(11)
    data = [(1, None, None, None), (1, None, "user", "Hi."), (None, 3, "user", "No id."), (None, None, "assistant", None),
            (2, 5, "system", "Be kind."), (2, 5, "system", "Be kind."), (2, 9, "user", "Well"), (3, 0, "", ""), (3, 1, "tool", "x.\n"),
            (4, 2, "assistant", "é! "), (4, 1, "assistant", "A.\t"), (4, 1, "user", "two\nlines?")]
    data += [(7, int(rng.integers(0, 300)), str(rng.choice(["user", "assistant", "system", "u2"])), str(rng.choice(["a.", "b?", "c", f"{i}!"])))
             for i in range(400)]                         # one long conversation, cut into slices
    rows = spark.createDataFrame([(*r, "clash", "clash") for r in data], "conv_id long, turn long, role string, text string, part string, seq string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        made = repair.repaired(rows).collect()
        assert repair.repaired(rows.limit(0)).collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    got = {r.conv_id: (*r[:8], sha(r.lines[:-1])) for r in made}
    for conv in {r[0] for r in data}:
        own = [(t, " " if ro is None else ro, " " if x is None else x) for c, t, ro, x in data if c == conv]
        assert got[conv] == plain_row(conv, own)


def test_repair_query_equals_plain_repair(spark):
    data = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    hurt = plain_damage(data)
    got = {r.conv_id: tuple(r) for r in repair.query(spark, SF).collect()}
    assert got.keys() == {r[0] for r in data}
    for conv in got:
        assert got[conv] == plain_row(conv, [r[1:] for r in hurt if r[0] == conv])


# --- repeated passages --------------------------------------------------------------

def plain_passages(data):
    """doc_id, text -> (n_bytes, spans, kept): every window looked up in a set, in order."""
    seen, out = set(), []
    for _, text in data:
        b = (text or "").encode()
        gone = set()
        for i in range(len(b) - 99):
            w = b[i:i + 100]
            if w in seen:
                gone.update(range(i, i + 100))
            seen.add(w)
        spans = []
        for i in sorted(gone):
            if spans and spans[-1][0] + spans[-1][1] == i:
                spans[-1][1] += 1
            else:
                spans.append([i, 1])
        out.append((len(b), spans, bytes(x for i, x in enumerate(b) if i not in gone)))
    return out


def test_matching_statistics():
    rng = np.random.default_rng(5)
    for _ in range(60):
        k = int(rng.choice([2, 3, 250]))
        refs = [bytes(rng.integers(0, k, rng.integers(1, 60)).astype(np.uint8)) for _ in range(rng.integers(1, 8))]
        patterns = [r + refs[0][:9] for r in refs] + [bytes(rng.integers(0, k, 40).astype(np.uint8))]
        least = int(rng.integers(1, 12))
        got = RunIndex(refs).matching_statistics(patterns, least)
        assert [g.tolist() for g in got] == [[i for i in range(len(p) - least + 1) if any(p[i:i + least] in r for r in refs)] for p in patterns]


@pytest.mark.parametrize("many", [64, 3])
def test_passages_of_awkward_rows(spark, monkeypatch, many):
    monkeypatch.setattr(passages, "MANY", many)
    monkeypatch.setattr(passages, "SAMPLE", 1)
    monkeypatch.setattr(passages, "INDEX_BYTES", 2000)
    monkeypatch.setattr(passages, "FLUSH_BYTES", 3000)
    rng = np.random.default_rng(9)

    def prose(n):
        return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(n))

    common, data = prose(40), [(1, None), (2, ""), (3, "short"), (4, "x" * 99), (5, "x" * 100), (6, "x" * 101), (7, "ab" * 400)]
    for i in range(10, 60):
        data.append((i, prose(int(rng.integers(0, 30))) + common + prose(int(rng.integers(0, 30)))))
    for i in range(60, 90):                               # copies with a letter changed
        t = data[i - 50][1]
        k = int(rng.integers(0, max(len(t), 1)))
        data.append((i, t[:k] + "é" + t[k + 1:]))
    data += [(100, data[20][1]), (101, common * 3), (102, "\0" * 250), (103, prose(3000) + common), (104, common[30:] + common[:50])]
    want = plain_passages(data)
    rows = [(None, data[12][1]), *data[::-1], data[40]]   # a null id comes first, a repeated row is one document
    df = spark.createDataFrame([(*r, 0, "clash") for r in rows], "doc_id long, text string, key long, bytes string").repartition(3)
    want = dict(zip([None] + [r[0] for r in data], plain_passages([(None, data[12][1]), *data])))
    got = passages.without_repeats(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, [[s.start, s.length] for s in r.spans], bytes(r.kept)) == want[r.doc_id], r.doc_id
    assert passages.without_repeats(df.limit(0)).collect() == []


def test_passages_query_equals_plain_search(spark):
    data = sorted((r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in passages.query(spark, SF).collect()}
    assert len(got) == len(data)
    for (i, _), (n, spans, kept) in zip(data, plain_passages(data)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, sum(s[1] for s in spans), len(spans), hashlib.sha256(kept).hexdigest())
    assert sum(r.n_removed > 0 for r in got.values()) > 10
