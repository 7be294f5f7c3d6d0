"""Seekable frames (11), SimHash (12) and spelling variants (13) against brute-force versions."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from panelflow.llm import components, middles, simhash, spelling

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def counted(df):
    return collections.Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def rows(odd_rows):
    marks = [(60, "a <P> b"), (61, "x<S>"), (62, "<M>"), (63, "<<P"), (64, "S><M"), (65, "é<" * 50), (66, "日本語" * 40), (67, "<P <S <M")]
    return odd_rows + marks


@pytest.fixture(scope="module")
def docs(docs_of, rows):
    return docs_of(rows).cache()


# 11


def brute_middle(doc_id, text):
    text, d = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("frame", [7, 64, middles.FRAME])
def test_middles(docs, rows, frame):
    rows = rows if frame > 7 else [r for r in rows if len(r[1] or "") < 5000]
    docs = docs if frame > 7 else docs.filter("text is null or length(text) < 5000")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    made = middles.rearrange(middles.store(docs, frame=frame), frame=frame).cache()
    want, outputs = collections.Counter(), collections.Counter()
    for d, t in rows:
        *head, out = brute_middle(d, t)
        want[d, *head, sha(out), sha(t or "")] += 1
        outputs[d, out] += 1
    assert counted(middles.digests(made)) == want
    assert counted(middles.texts(made)) == outputs
    assert counted(middles.texts(middles.restore(made))) == collections.Counter((d, t or "") for d, t in rows)
    assert {f for _, f, *_ in map(lambda r: brute_middle(*r), rows)} == {"plain", "psm", "spm"}


def test_frames_are_sought_not_scanned():
    rng = random.Random(1)
    text = "".join(rng.choice("aé日\U0001f600 ") for _ in range(5000))
    writer = middles.Writer(100)
    for i in range(0, 5000, 333):
        writer.add(text[i : i + 333].encode())
    units, ends, blob = writer.done()
    assert units[-1] == 5000 and ends[-1] == len(blob) and len(units) > 50
    reader = middles.Reader(units, ends, blob)
    opened = []
    frame, reader.frame = reader.frame, lambda i: opened.append(i) or frame(i)
    for _ in range(200):
        a, b = sorted((rng.randint(0, 5000), rng.randint(0, 5000)))
        opened.clear()
        assert b"".join(reader.read(a, b)).decode() == text[a:b]
        touched = [i for i, u in enumerate(units) if u > a and (units[i - 1] if i else 0) < b] if a < b else []
        assert opened == touched


def test_middles_of_no_rows(docs):
    assert middles.digests(middles.rearrange(middles.store(docs.limit(0)))).count() == 0


# 12


def brute_fingerprint(text):
    words = WORD.findall(lowered(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values, distance=2):
    values = np.array(sorted(set(values)), np.uint64)
    label = np.arange(len(values))
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= distance
    while True:
        lower = np.where(near, label[None, :], len(values)).min(axis=1)
        if (lower == label).all():
            return dict(zip(values.tolist(), label.tolist()))
        label = lower


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 2])
def test_simhash(docs, rows, bucket):
    prints = [brute_fingerprint(t) for _, t in rows]
    label = brute_components(prints)
    smallest = {}
    for (d, _), p in zip(rows, prints):
        if d is not None:
            smallest[label[p]] = min(d, smallest.get(label[p], d))
    want = collections.Counter((d, f"{p:016x}", smallest.get(label[p])) for (d, _), p in zip(rows, prints))
    assert counted(simhash.group(docs, bucket=bucket)) == want


@pytest.mark.parametrize("piece", [40, 1000])
def test_simhash_of_texts_in_pieces(monkeypatch, rows, piece):
    import pyarrow as pa

    monkeypatch.setattr(simhash, "PIECE", piece)
    for _, text in rows + [(0, "one " + "b" * 3000), (0, "c" * 3000), (0, "x " * 3000), (0, " " * 3000 + "y"), (0, "  A B C\x1cD e" * 99)]:
        got = simhash.fingerprint_values(pa.array([text or ""], pa.large_string()))
        assert got.tolist() == [brute_fingerprint(text)]


def test_shingle_counts_beyond_a_byte():
    import pyarrow as pa

    texts = [("ab cd " * n + "e").strip() for n in (100, 127, 128, 129, 255, 256, 300, 5000)]
    assert simhash.fingerprint_values(pa.array(texts, pa.large_string())).tolist() == [brute_fingerprint(t) for t in texts]


def test_only_whitespace_of_the_contract_parts_words(docs_of):
    texts = ["a b c d e", "A B c\td\x0be", "a b c d e"]
    got = {r["doc_id"]: r["fingerprint"] for r in simhash.group(docs_of(list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(3)] == [f"{brute_fingerprint(t):016x}" for t in texts]


@pytest.mark.parametrize("bucket", [2048, 16])
def test_hot_buckets_lose_no_link(spark, bucket):
    """A cloud around one value, with a segment that most of it shares, and chains of two-bit steps."""
    rng = random.Random(7)
    centre, values = rng.getrandbits(64), set()
    for _ in range(700):
        v = centre
        for b in rng.sample(range(64), rng.choice((1, 2, 3, 4))):
            v ^= 1 << (b if rng.random() < 0.5 else b % 32)
        values.add(v)
    for _ in range(20):
        v = rng.getrandbits(64)
        for _ in range(8):
            values.add(v)
            for b in rng.sample(range(64), 2):
                v ^= 1 << b
    values |= {0, 2**64 - 1, 1, 3, 7}
    table = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "value long").repartition(4).cache()
    roots = {r["node"] % 2**64: r["root"] % 2**64 for r in components.components(simhash.links(table, bucket)).collect()}
    label = brute_components(values)
    members, got = collections.defaultdict(set), collections.defaultdict(set)
    for v in values:
        members[label[v]].add(v)
        got[roots.get(v, v)].add(v)
    assert sorted(map(sorted, members.values())) == sorted(map(sorted, got.values()))


def test_simhash_of_no_rows(docs):
    assert simhash.group(docs.limit(0)).count() == 0


# 13


def brute_spelling(rows):
    total = collections.Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    n = {w: k for w, k in total.items() if len(w) >= 5 and k >= 3}

    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]

    form, out = {}, {}
    for w in n:
        others = [v for v in n if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = len(others)
    result = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        result.add((w, form[w], root, n[w], out[w], n[form[w]] if form[w] else None))
    return result


@pytest.fixture(scope="module")
def misspelt():
    rng = random.Random(3)
    bases = ["colour", "naïveté", "straße", "grün×rot", "Àÿçúü", "honour", "aaaaa", "separate", "b" * 40, "abcabcabc"]
    rows = []
    for d in range(120):
        words = []
        for _ in range(rng.randint(0, 40)):
            w = list(rng.choice(bases))
            for _ in range(rng.choice((0, 0, 0, 0, 1, 1, 2))):
                at = rng.randrange(len(w) + 1)
                kind = rng.random()
                if kind < 0.4 and at < len(w):
                    w[at] = rng.choice("aeÉ")
                elif kind < 0.7 and at < len(w):
                    del w[at]
                else:
                    w.insert(at, rng.choice("aeé"))
            w = "".join(w)
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((d, rng.choice((" ", "-", "1", "\n", "ŀ")).join(words)))
    return rows + [(200, None), (201, ""), (202, "z" * 3000 + " " + "z" * 2999 + "a"), (203, ("z" * 3000 + " ") * 7), (204, ("z" * 2999 + "a ") * 3), (None, "colour honour " * 60), (None, None)]


@pytest.mark.parametrize(("tile", "step"), [(spelling.TILE, spelling.STEP), (2, 1 << 16)])
def test_spelling(docs_of, misspelt, odd_rows, tile, step):
    rows = misspelt + misspelt[:30] + odd_rows
    got = spelling.group(docs_of(rows), tile=tile).collect()
    want = brute_spelling(rows)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert any(f and r != f for _, f, r, *_ in want), "no chain of forms in the fixture"


def test_fewer_symbols_give_the_same(docs_of, misspelt):
    docs = docs_of(misspelt)
    assert counted(spelling.group(docs, symbols=2, tile=3)) == counted(spelling.group(docs))


def test_neighbourhoods_are_full_and_distinct(monkeypatch):
    own = lambda w: int(next(spelling.neighbours(w))[0])
    for step in (2, 1 << 16):
        monkeypatch.setattr(spelling, "STEP", step)
        for word in (b"abcab", b"aabbb", b"hhhh", b"a", b"abcdefghgfedcba"):
            around = {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}
            for s in b"abcdefgh":
                around |= {word[:i] + bytes([s]) + word[i + 1 :] for i in range(len(word))}
                around |= {word[:i] + bytes([s]) + word[i:] for i in range(len(word) + 1)}
            assert sorted(np.concatenate(list(spelling.neighbours(word))).tolist()) == sorted(map(own, around))


def test_spelling_of_no_rows(docs_of):
    assert spelling.group(docs_of([(1, None), (2, "")])).count() == 0
    assert spelling.group(docs_of([(1, "x")]).limit(0)).count() == 0


def test_slices_of_a_batch(rows):
    """Operators see slices of larger Arrow arrays, whose offsets do not start at zero."""
    import pyarrow as pa

    texts = pa.array([t or "" for _, t in rows], pa.large_string())
    whole = simhash.fingerprint_values(texts)
    for first in (1, 5, 11, 20):
        part = texts.slice(first, 7)
        assert simhash.fingerprint_values(part).tolist() == whole[first : first + 7].tolist()
        words = collections.Counter(lowered(w) for t in part.to_pylist() for w in re.findall("[A-Za-zÀ-ÿ]{5,}", t))
        got = spelling._count(part, [None] * 7)
        assert sum(got.values()) <= sum(words.values()) and all(n <= words[w] for w, n in got.items() if w in words)
