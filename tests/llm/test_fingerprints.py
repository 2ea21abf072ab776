"""Fingerprints, edited texts and likeness against a byte-by-byte program."""

import hashlib
import random
import zlib

from surveyloom.llm import fingerprints as P, queries as Q


def plain_print(text):
    data, marks = text.encode(), []
    for i in range(len(data)):
        h = 0
        for k in range(min(7, i + 1)):
            x = int(P._TABLE[data[i - k]])
            h ^= (x << 3 * k | x >> (32 - 3 * k)) & 0xFFFFFFFF
        marks.append(h ^ h >> 15)

    def pieces(size):
        found, begin = [], 0
        for i, h in enumerate(marks):
            if h % size == size - 1 or i == len(data) - 1:
                found.append(data[begin:i + 1])
                begin = i + 1
        return found
    size = 4
    while len(pieces(size)) > 64:
        size *= 2
    symbol = lambda c: chr(0x4E00 + ((c ^ c >> 12 ^ c >> 24) & 0xFFF))
    return ":".join([str(size), *("".join(symbol(zlib.crc32(p)) for p in pieces(s)) for s in (size, 2 * size))])


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def plain_likeness(a, b):
    one = {int(a.split(":")[0]) << k: s for k, s in enumerate(a.split(":")[1:])}
    two = {int(b.split(":")[0]) << k: s for k, s in enumerate(b.split(":")[1:])}
    both = sorted(one.keys() & two.keys())
    if not both:
        return 0.0
    x, y = one[both[0]], two[both[0]]
    return 1 - distance(x, y) / max(len(x), len(y), 1)


def plain(rows):
    rows = [(i, t or "") for i, t in rows]
    for (i, t), (_, then) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 3
        edited = t[:len(t) - k] + then[:k]
        own, other, next_own = plain_print(t), plain_print(edited), plain_print(then)
        yield i, len(t), hashlib.sha256(edited.encode()).hexdigest(), own, other, plain_likeness(own, other), plain_likeness(own, next_own)


ODD = [None, "", "a", "ab", "abc", "é" * 100, "日本語 😀 " * 40, "x" * 5000, "\0\n", "word " * 2000, " " * 70]


def test_query_equals_plain_program(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 5000")
    more = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(ODD, 90)], docs.schema)
    all_docs = docs.filter("doc_id < 90 or doc_id > 120").unionByName(more)
    all_docs.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(((r["doc_id"], r["text"]) for r in all_docs.collect()), reverse=True)
    want = sorted(plain(rows))
    got = sorted(tuple(r) for r in Q.QUERIES["op11_fingerprints"](spark, str(tmp_path)).collect())
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert all(abs(g - w) < 1e-12 for r, s in zip(got, want) for g, w in zip(r[5:], s[5:]))


def test_edited_texts_are_near_and_others_are_not(spark):
    rows = P.beside_next(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("n_chars >= 200")
    near = sorted(r["near_edited"] for r in rows.collect())
    far = sorted(r["near_next"] for r in rows.collect())
    assert near[len(near) // 2] > 0.55 and near[len(near) // 100] > 0.3 and far[len(far) // 2] < 0.1


def test_a_border_changes_only_what_is_near_it():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    a, b = P.fingerprint(text), P.fingerprint("something put before " + text)
    assert plain_likeness(a, b) > 0.8 and P.fingerprint(text) == a


def test_odd_tables(spark):
    kinds = "doc_id bigint, text string, fingerprint string, _range int"
    one = spark.createDataFrame([(None, "abcdef", "z", 1)], kinds)
    r = P.beside_next(one).collect()
    assert len(r) == 1 and r[0]["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and r[0]["near_next"] == 1
    same = spark.createDataFrame([(7, "same text " * 30, "z", 1)] * 400 + [(None, None, "z", 2)] * 3, kinds)
    got = P.beside_next(same).collect()
    assert len(got) == 403 and sum(r["near_next"] == 1 for r in got) >= 401
    assert P.beside_next(one.limit(0)).count() == 0 and P.fingerprints(one.limit(0)).count() == 0
