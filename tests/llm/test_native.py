"""Secret scans, quality rules and URL filters against plain programs."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import types as T

from surveyloom.llm import quality, secrets, urls

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("_row", T.StringType()),
    T.StructField("n_words", T.StringType())])
SF = "/root/testdata/sf0.001"


def frame(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "s", None if t is None else len(t), "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


SECRETS = [
    None, "", "password: token: abcdefghijklmnop", "token=" + "a" * 11, "x TOKEN = 'abcdefghijkl' é AKIAABCDEFGHIJKLMN",
    "pässword password=aaaaaaaaaaaa" + "0123456789abcdef" * 3, "AKIAAKIAB AKIA" + "A" * 13 + "a AKIA" + "A" * 14,
    "user=bob\n" + "pwd=hunter22", "pwd=hunter22 alone", "host 10.0.0.1:22 " + "z " * 300 + "pwd=hunter22",
    "see https://db.example.com/x login: al_ice and pin=8812 " * 3, "auth: https://docs.example.com/guide", "pin: 10.0.0.1", "pin: 10.0.0.1 pin: 10.0.0.2", "deadbeef" * 2, "api_key\"=\"" + "Z9" * 9, "é" * 70000 + "0" * 16,
]


def base_spans(text):
    text = text or ""
    out = []
    for kind, pattern, least, group in (
            ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
            ("access", "AKIA[A-Z0-9]+", 18, 0), ("hex", "[0-9a-f]+", 16, 0)):
        flags = re.I | re.A if kind == "assign" else 0
        out.append([(m.start(), m.end()) for m in re.finditer(pattern, text, flags) if len(m.group(group)) >= least])
    return out


def joined(lists, kinds):
    flat = sorted((s, i, e) for i, spans in enumerate(lists) for s, e in spans)
    return ",".join(f"{kinds[i]}:{s}:{e}" for s, i, e in flat)


def weak_spans(text):
    """Every weak part with a complementary part in its scope, by looking at all parts."""
    text = text or ""
    base = base_spans(text)
    every = [(k, s, e) for k, spans in zip(secrets.BASE, base) for s, e in spans]
    for kind, _, pattern in secrets.WEAK:
        every += [(kind, m.start(), m.end()) for m in re.finditer(re.sub(r"\(\?i:(.*?)\\b\)", r"(?i:\1\\b)", pattern), text, re.A)]
    role = secrets.ROLES
    out = []
    for k, s, e in every:
        if k in secrets.BASE:
            out.append((k, s, e))
            continue
        near = {role[o] for o, t, u in every if 0 <= t - e <= secrets.SCOPE or 0 <= s - u <= secrets.SCOPE}
        if {"secret": bool(near & {"id", "endpoint"}), "id": "secret" in near, "endpoint": {"id", "secret"} <= near}[role[k]]:
            out.append((k, s, e))
    out.sort(key=lambda x: (x[1], secrets.RANK[x[0]], x[2]))
    return ",".join(f"{k}:{s}:{e}" for k, s, e in out)


def check_secrets(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    got = secrets.report(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        base = base_spans(texts[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [len(b) for b in base]
        assert r["base_sha256"] == hashlib.sha256(joined(base, secrets.BASE).encode()).hexdigest()
        assert r["spans"] == weak_spans(texts[r["doc_id"]]), r["doc_id"]
    return got


def test_secrets_of_odd_texts(spark):
    got = {r["doc_id"]: r for r in check_secrets(spark, frame(spark, SECRETS))}
    assert "phrase" in got[7]["spans"] and "login" in got[7]["spans"]
    assert got[8]["spans"] == "" and got[9]["spans"] == ""
    assert "endpoint" in got[10]["spans"] and got[11]["spans"] == got[12]["spans"] == ""
    assert got[13]["spans"] == "phrase:0:13,phrase:14:27"


def test_secrets_of_documents(spark):
    check_secrets(spark, spark.read.parquet(f"{SF}/documents.parquet"))


def test_secrets_redacted_and_other_columns_kept(spark):
    docs = frame(spark, SECRETS + [SECRETS[4]], ids=[*range(len(SECRETS)), None])
    got = secrets.redact(docs).collect()
    assert len(got) == len(SECRETS) + 1 and got[0].__fields__ == DOCS.names
    for r in got:
        assert not any(base_spans(r["text"])) and (r["text"] is None or r["n_chars"] == len(r["text"]))
    by_id = {r["doc_id"]: r["text"] for r in got}
    assert by_id[8] == SECRETS[8] and by_id[2] == SECRETS[2] and by_id[4] == "x [SECRET]' é [SECRET]"
    assert secrets.redact(frame(spark, [])).count() == 0 and secrets.report(frame(spark, [])).count() == 0


def brute_quality(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    often = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


QUALITY = [None, "", " \n\t", "a", "a b c d e a b c d e", "x " * 40, "l1 w\nl1 w\n\nl1 w \n", "#*$%&|<> é ß", "q " + "wört " * 4 + "q " * 9,
           " ".join(str(i) for i in range(30000)), "the of and " * 3000, "a\u00a0b c\u3000d", "one two three four five six\rseven\x0beight\x0cnine ten"]


def check_quality(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    got = quality.judge(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute_quality(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, r
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
    return got


def test_quality_of_odd_texts(spark):
    for r in check_quality(spark, frame(spark, QUALITY)):
        assert not (r["base_failed"] and r["kept"])
    assert quality.judge(frame(spark, [])).count() == 0


def divergence(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q)]
    return sum((a * math.log2(a / c) if a else 0) + (b * math.log2(b / c) if b else 0) for a, b, c in zip(p, q, m)) / 2


def test_quality_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in check_quality(spark, docs)}
    rows = {r["doc_id"]: r for r in docs.collect()}
    patterns = [re.compile(x) for x in ("[a-z]", r"[\x20\x09-\x0D]", "[A-Z]", "[0-9]", r"[.,;:!?'\"()\-]", "[#*$%&|<>]", r"[^\W\d_]")]
    chars, common = {}, {}
    for i, r in rows.items():
        t, hist = r["text"], []
        for p in patterns:
            hist.append(len(p.findall(t)))
            t = p.sub("", t)
        hist.append(len(t))
        chars[i] = [x / max(sum(hist), 1) for x in hist]
        w = words(r["text"])
        c = Counter(x.lower() for x in w if x.lower() in quality.COMMON_WORDS)
        common[i] = [c[x] / max(len(w), 1) for x in sorted(set(quality.COMMON_WORDS))]
        common[i].append(1 - sum(common[i]))
    for lang in {r["lang"] for r in rows.values()}:
        own = [i for i, r in rows.items() if r["lang"] == lang]
        solid = [i for i in own if not got[i]["base_failed"] and got[i]["n_words"] >= quality.MIN_CHAR_WORDS]
        mean = lambda h: [sum(h[i][k] for i in solid) / len(solid) for k in range(len(h[solid[0]]))]
        a, b = mean(chars), mean(common)
        for i in own:
            r = got[i]
            far = 0
            if r["n_words"] >= quality.MIN_CHAR_WORDS:
                assert r["char_divergence"] == pytest.approx(divergence(chars[i], a), abs=1e-6)
                far = r["char_divergence"] > quality.MAX_CHAR_DIVERGENCE
            if r["n_words"] >= quality.MIN_COMMON_WORDS:
                assert r["word_divergence"] == pytest.approx(divergence(common[i], b), abs=1e-6)
                far |= r["word_divergence"] > quality.MAX_COMMON_DIVERGENCE
            assert r["kept"] == (not r["base_failed"] and not far)


URLS = [None, "", "nope", "://", "http://", "http://A.Example.NET/en/x?y#z", "https://example.net/enx", "http://net", "http://net/", "x://my.net?q=/en/",
        "http://example.com/de/1", "http://notexample.com/de/1", "http://w.org/fr/", "http://w.org/de/", "a://b://c/d", "http://ü.org/ß", "http://h.org:80/fr/a\nb"]


def brute_url(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, a) for a, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def check_urls(pages):
    want = {r["page_id"]: brute_url(r["url"]) for r in pages.select("page_id", "url").collect()}
    got = urls.judge(pages).collect()
    assert len(got) == len(want)
    for r in got:
        host, path, rule, verdict = want[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or r["verdict"]) and r["verdict"] in ("allow", "block")
    return got


def model_by_hand(texts):
    """ln p_block - ln p_allow per character, with the module's smoothing and backing off."""
    n = [Counter(), Counter()]
    contexts = [Counter(), Counter()]
    for text, side in texts:
        padded = urls.START * 3 + text
        for i in range(3, len(padded)):
            for k in range(1, 5):
                n[side][padded[i - k + 1:i + 1]] += 1
                contexts[side][(padded[i - k + 1:i])] += 1
    kept = {g for g in n[0] | n[1] if len(g) == 1 or n[0][g] + n[1][g] >= urls.MIN_COUNT}
    d, size = urls.DISCOUNT, sum(len(g) == 1 for g in kept)

    def p(g, side):
        shorter = 1 / (size + 1) if len(g) == 1 else p(g[1:], side)
        return (n[side][g] + d * shorter) / (contexts[side][g[:-1]] + d)

    def ratio(g):
        if g in kept:
            return math.log(p(g, 1)) - math.log(p(g, 0))
        if len(g) == 1:
            return 0.0
        c = g[:-1]
        return ratio(g[1:]) + (math.log(contexts[0][c] + d) - math.log(contexts[1][c] + d) if c in kept else 0.0)

    def mean(text):
        padded = urls.START * 3 + text
        return sum(ratio(padded[i - 3:i + 1]) for i in range(3, len(padded))) / len(text) if text else None
    return mean


def test_urls(spark):
    schema = "page_id bigint, url string, host string, _row int"
    check_urls(spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(URLS)], schema))
    assert urls.judge(spark.createDataFrame([], schema)).count() == 0
    got = check_urls(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    def plain(r):
        host, path = r["host"], r["path"]
        if not host and not path:
            return ""
        host = host[:len(host) - max(len(h) if host == h or host.endswith("." + h) else 0 for _, h, _ in urls.RULES)]
        path = path[max(len(p) if path.startswith(p) else 0 for _, _, p in urls.RULES):]
        return re.sub(r"[^\x21-\x7e]", "?", re.sub("[0-9]", "0", f"{host}/{path}".lower()))
    folds = {r["page_id"]: r["fold"] for r in spark.createDataFrame([(r["page_id"], plain(r)) for r in got], "page_id bigint, t string").selectExpr(
        "page_id", f"pmod(xxhash64(t, 10), {urls.FOLDS}) AS fold").collect()}
    mean = model_by_hand([(plain(r), int(r["verdict"] == "block")) for r in got if r["rule"] and folds[r["page_id"]] > 1])
    for r in got:
        assert r["score"] == pytest.approx(mean(plain(r)), abs=1e-9)
    open_ones = [r for r in got if not r["rule"]]
    by_host = {}
    for r in open_ones:
        by_host.setdefault(".".join(r["host"].split(".")[-2:]), set()).add(r["verdict"])
    assert any(len(v) == 2 for v in by_host.values())  # no echo of where a host ends
    assert max(r["score"] for r in open_ones if r["verdict"] == "allow") < min([9.0] + [r["score"] for r in open_ones if r["verdict"] == "block"])


def test_url_held_out_error(spark):
    error = {r["action"]: r for r in urls.held_out_error(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).collect()}
    print({a: (r["n"], r["wrong"]) for a, r in error.items()})
    assert set(error) == {"allow", "block"} and all(0 <= r["wrong"] <= r["n"] for r in error.values())


def test_every_language_has_its_own_reference(spark):
    latin, other = "a few small words of one and the same kind " * 4, "слова другого письма из малого языка " * 5
    rows = [(100 * k + i, f"{latin} {k} {'x' * i}", f"l{k}") for k in range(80) for i in range(3)]
    rows += [(9000 + i, f"{other} {i}", "zz") for i in range(2)] + [(9100, other, "alone"), (9101, "short", "none")]
    rows = [(i, " ".join(f"{w}{n}" for n, w in enumerate(t.split())), g) for i, t, g in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert len(got) == len(rows) and not got[9101]["kept"]
    assert all(r["kept"] and r["char_divergence"] < 0.01 for i, r in got.items() if i != 9101)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:  # references too large to broadcast
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert {r["doc_id"]: r for r in quality.judge(docs).collect()} == got
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_url_model_keeps_every_frequent_gram(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0-./_~!$&'()*+,;=:", k=400)) + "rare" for _ in range(1500)]
    rows = [(i, x, "block" if i % 2 else "allow") for i, x in enumerate(texts)]
    at = spark.createDataFrame(rows, "_row bigint, _text string, action string")
    model = urls.train(at)
    counts = Counter(x[max(0, i - k):i] for t in texts for x in ["^^^" + t] for i in range(4, len(x) + 1) for k in range(1, 5))
    got = {r["gram"]: r for r in model.collect()}
    assert got.keys() == {g for g, n in counts.items() if len(g) == 1 or n >= urls.MIN_COUNT} and len(got) > 60_000

    def value(g):
        if g in got:
            return got[g]["ratio"]
        return value(g[1:]) + (got[g[:-1]]["back"] if g[:-1] in got else 0.0) if len(g) > 1 else 0.0
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:  # a model too large to broadcast
        for size in (threshold, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
            some = {r["_row"]: r["score"] for r in urls.score(at.filter("_row < 20"), model, "_row").collect()}
            for i in range(20):
                x = "^^^" + texts[i]
                assert some[i] == pytest.approx(sum(value(x[j - 4:j]) for j in range(4, len(x) + 1)) / len(texts[i]), abs=1e-9)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_scope_is_the_gap_between_parts(spark):
    blob = "aB3" * 140
    texts = [f"{blob} https://db.example.com/x", f"auth: {'t' * 400} https://db.example.com/x", f"auth: {'t' * 400} https://db.example.com/x login: bob",
             *[f"pwd={'q' * 300}{' ' * n}10.0.0.1" for n in (255, 256, 257)], *[f"10.0.0.1{' ' * n}pwd={'q' * 700}" for n in (256, 257)]]
    rng = random.Random(7)
    bits = ["10.0.0.1", "pin=8812", "login: al_ice", "https://h.example/" + "p" * 300, "pwd=" + "q" * 600, "AKIA" + "A" * 16]
    texts += ["".join(rng.choice(bits) + " " * rng.randrange(1, 500) for _ in range(8)) for _ in range(60)]
    got = {r["doc_id"]: r["spans"] for r in secrets.report(frame(spark, texts)).collect()}
    weak = [k for k, _, _ in secrets.WEAK]
    for i, text in enumerate(texts):
        every = [(k, s, e) for k, spans in zip(secrets.BASE, base_spans(text)) for s, e in spans]
        for kind, _, pattern in secrets.WEAK:
            every += [(kind, m.start(), m.end()) for m in re.finditer(re.sub(r"\(\?i:(.*?)\\b\)", r"(?i:\1\\b)", pattern), text, re.A)]
        out = []
        for k, s, e in every:
            near = {secrets.ROLES[o] for o, t, u in every if 0 <= t - e <= secrets.SCOPE or 0 <= s - u <= secrets.SCOPE}
            if k not in weak or {"secret": bool(near & {"id", "endpoint"}), "id": "secret" in near, "endpoint": {"id", "secret"} <= near}[secrets.ROLES[k]]:
                out.append((s, secrets.RANK[k], e, k))
        assert got[i] == ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out)), i
    assert got[0] == f"blob:0:{len(blob)}" and "endpoint" in got[2] and "phrase" in got[4] and got[5] == "" and got[7] == ""
