"""Secret scan and URL filter against plain Python; odd inputs; no Python in their plans."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
from conftest import frame, words  # tests/llm/conftest.py

from plenum.llm import queries
from plenum.llm import secrets as sc
from plenum.llm import url_filter as uf
from plenum.llm.common import table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 16]
    return sorted(out)


def check(rows, texts):
    for r in rows:
        spans = base_spans(texts[r.doc_id])
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in spans) for i in range(3)), texts[r.doc_id][:300]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("random")] == [s for s in joined.split(",") if s]


def test_secrets(spark, sf):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    rows = queries.op3_secret_scan(spark, sf).collect()
    assert len(rows) == len(texts)
    check(rows, texts)


def test_secret_patterns(spark):
    r = random.Random(1)
    parts = ["password", "API_KEY", "apikey", "token", "Secret", "paſſwd", "toKen", "=", ":", " = ", '"', "'", " ", "abcdefghijkl", "0123456789abcdef", "AKIA", "ABCDEFGHIJKLMNOP", "é😀", "\n", "deadbeef", "x.y-z_w/+="]
    texts = {i: "".join(r.choice(parts) for _ in range(r.randint(0, 25))) for i in range(400)}
    texts |= {400: "", 401: "😀 token = 'abcdefghijklmnop'", 402: "a" * 50_000 + " AKIA" + "Z" * 14}
    check(sc.secret_digest(sc.secrets(frame(spark, list(texts.items())))).collect(), texts)


def test_random_tokens(spark):
    r = random.Random(7)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rows, planted = [], {}
    for i in range(300):
        text = " ".join(words(i, 40, 2000)) + " camelCaseIdentifierNumber2 someLongPathName/withParts/andMore_2024 aaaaAAAA1111aaaaAAAA1111"
        if i % 10 == 0:
            key = "".join(r.choices(alphabet, k=48))
            planted[i] = f"random:{len(text) + 1}:{len(text) + 49}"
            text += " " + key
        rows.append((i, text))
    got = {x.doc_id: x.spans for x in sc.secret_digest(sc.secrets(frame(spark, rows))).collect()}
    found = sum(planted[i] in got[i].split(",") for i in planted)
    assert found >= 0.8 * len(planted) and sum(bool(s) for i, s in got.items() if i not in planted) <= 3


def test_random_tokens_of_each_alphabet(spark):
    """Long keys over restricted alphabets, tested over their own alphabet, are as random as those of base64."""
    r, rows, planted = random.Random(9), [], {}
    for alphabet in (sc.BASE36, sc.BASE36.upper(), sc.BASE32, sc.BASE32.lower(), sc.BASE58, sc.BASE62, sc.BASE64):
        for n in (24, 32, 40, 48, 64, 128):
            for _ in range(5):
                i = len(rows)
                planted[i] = (alphabet, n, "random:6:" + str(6 + n))
                rows.append((i, "words " + "".join(r.choices(alphabet, k=n)) + " end"))
    got = {x.doc_id: x.spans for x in sc.secret_digest(sc.secrets(frame(spark, rows))).collect()}
    for alphabet in {a for a, *_ in planted.values()}:
        of = [got[i] == span for i, (a, n, span) in planted.items() if a == alphabet and n >= 40]
        assert sum(of) >= 0.85 * len(of), (alphabet, sum(of), len(of))


def tested_by_force(token):
    """band, battery bin and word bin of a token: the tests of the docstring, in plain Python."""
    body = token.translate(str.maketrans("-_", "+/")).rstrip("=")
    n = len(body)
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", body):
        alphabet, text, fitting = sc.HEX, body.lower(), 16
    elif re.fullmatch("[A-Z2-7]+", body):
        alphabet, text, fitting = sc.BASE32, body, 32
    else:
        alphabet, text = sc.BASE64, body
        fitting = next((size for pattern, size in sc.ALPHABETS if re.search(pattern, body)), 64)
    size, squares = len(alphabet), sum(text.count(c) ** 2 for c in alphabet)
    codes = [alphabet.find(c) + 1 for c in text]  # "=" within a token is no symbol
    upper = ["=" if not c else "1" if c > size // 2 else "0" for c in codes]
    ones = upper.count("1")
    runs = 1 + sum(a != b and "=" not in (a, b) for a, b in zip(upper, upper[1:]))
    mean_runs = 1 + 2 * ones * (n - ones) / n
    z_runs = (runs - mean_runs) / math.sqrt(max((mean_runs - 1) * (mean_runs - 2) / (n - 1), 1e-9))
    middle = sum(codes) / n
    z_serial = math.sqrt(n) * sum((a - middle) * (b - middle) for a, b in zip(codes, codes[1:])) / max(sum((c - middle) ** 2 for c in codes), 1e-9)
    chi = squares * size / n - n
    z_even = (squares * fitting / n - n - (fitting - 1)) / math.sqrt(2 * (fitting - 1) * (n - 1) / n)
    uneven = (n - 1) * max(size * 0.066 - 1, 0.5)
    z = (size - 1 + uneven - chi) / math.sqrt(2 * (size - 1) + 4 * uneven)
    word = (z * z / 2 + math.log(2)) / math.log(10) if z > 0 else 0
    x = z_even**2 + z_runs**2 + z_serial**2
    battery = (x - 3 - 3 * math.log(x / 3)) / 2 / math.log(10) if x > 3 else 0
    return sum(n >= b for b in (28, 40, 64)), int(min(battery, 60) / 0.1), int(min(word, 60) / 0.1)


def added_by_force(texts):
    tokens = []
    for d, text in texts.items():
        base = base_spans(text)
        for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text or ""):
            t = m.group()
            mixed = bool(re.search("[0-9]", t)) + bool(re.search("[a-z]", t)) + bool(re.search(".[A-Z]", t))
            if mixed >= 2 and all(b <= m.start() or m.end() <= a for a, _, b in base):
                tokens.append((d, m.start(), m.end(), *tested_by_force(t)))

    def least(rows, column):
        out = {}
        for band in {t[3] for t in rows}:
            bins = sorted((t[column] for t in rows if t[3] == band), reverse=True)
            for k, at in enumerate(bins, 1):
                if (k == len(bins) or bins[k] != at) and 10 ** (-at * 0.1) <= 0.01 * k / len(bins):
                    out[band] = at
        return out

    even = least(tokens, 4)
    judged = [(*t[:5], t[5] if t[4] < even.get(t[3], 10**9) else 0) for t in tokens]
    word = least(judged, 5)
    return {(d, a, b) for d, a, b, band, battery, at in judged if battery < even.get(band, 10**9) and at >= word.get(band, 10**9)}


def test_added_spans_equal_plain_python(spark, sf):
    r = random.Random(11)
    texts = {x.doc_id: x.text for x in table(spark, sf, "documents").collect()}
    top = max(texts) + 1
    pieces = ["password=", "AKIA", " ", "\n", ":", "deadbeefdeadbeef", "camelCaseIdentifierNumber2", "some/long/path/Name-With-3", "aaaaAAAA1111aaaaAAAA1111", "\ue000", "é"]
    for i in range(300):
        text = ""
        for _ in range(r.randrange(1, 9)):
            alphabet = r.choice([sc.BASE64, sc.BASE62, sc.BASE36, sc.BASE32, sc.HEX.upper()])
            text += r.choice([r.choice(pieces), "".join(r.choices(alphabet, k=r.randrange(10, 90))), " ".join(words(i, 4, 2000))]) + r.choice(["", " ", "\n"])
        texts[top + i] = text
    docs = frame(spark, list(texts.items()))
    got = {(x.doc_id, s.start, s.end) for x in sc.secrets(docs).collect() for s in x.added}
    want = added_by_force(texts)
    assert got == want and len(want) > 100


def test_secrets_of_a_text_with_many(spark):
    """Thousands of matches and tokens in one text."""
    r = random.Random(3)
    lines = [f"password = {'x' * 12}{i} {''.join(r.choices(sc.BASE64, k=30))} 0123456789abcdef{i:x}" for i in range(5_000)]
    texts = {1: "\n".join(lines), 2: "nothing here"}
    rows = sc.secret_digest(sc.secrets(frame(spark, list(texts.items())))).collect()
    check(rows, texts)
    assert {x.doc_id: (x.n_assign, x.n_hex) for x in rows}[1] == (5_000, 5_000)


def test_secrets_odd(spark, odd, empty):
    rows = sc.secret_digest(sc.secrets(odd)).collect()
    assert len(rows) == odd.count() and all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in rows)
    assert sc.secret_digest(sc.secrets(empty)).count() == 0


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest).group()
    path = re.match("[^?#]*", rest[len(host) :]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def ruled(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_urls(spark, sf):
    urls = {r.page_id: r.url for r in table(spark, sf, "pages").collect()}
    rows = queries.op7_url_filter(spark, sf).collect()
    assert len(rows) == len(urls)
    for r in rows:
        rule, verdict = ruled(*parse(urls[r.page_id]))
        assert (r.host, r.path) == parse(urls[r.page_id]) and r.rule == rule
        assert r.verdict == verdict if rule else r.verdict == ("allow" if r.score >= r.threshold else "block")


def test_url_odd(spark):
    odd = ["HTTP://WWW.Example.COM/en/7x?a=/en/8#z", "http://com/en/", "http://xcom/en/", "https://a.example.net?b", "://net/de/1", "x://y://net/de/1", "http://ÄB.org/es/", None, "", "no url", "http://a.com:80/en/1", "http://u@b.net/de/", "http://b.net/de/#?", "a" * 3000 + "://org/es/" + "b" * 3000]
    pages = spark.createDataFrame([(i, u, "h", "clash") for i, u in enumerate(odd * 2)] + [(None, "http://com/en/", None, None)], "page_id long, url string, html string, verdict string")
    rows = uf.url_filter(pages).collect()
    assert len(rows) == len(odd) * 2 + 1
    for r in rows:
        if r.page_id is not None:
            url = odd[r.page_id % len(odd)]
            assert (r.host, r.path) == parse(url) and r.rule == ruled(*parse(url))[0] and r.verdict in ("allow", "block")
    assert uf.url_filter(pages.limit(0)).count() == 0


def test_url_model(spark):
    """Scores against the same model in plain Python, all labelled URLs counted."""
    r = random.Random(3)
    urls = [f"http://{r.choice(['good', 'bad', 'shop'])}{r.randrange(9)}.{r.choice(['com', 'net', 'org', 'de'])}/{r.choice(['en', 'de', 'es'])}/{r.randrange(99)}" for _ in range(300)]
    config = uf.UrlConfig(order=3, held_out=1_000_000)
    rows = uf.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), config).collect()
    k = config.order
    counts = {c: [defaultdict(lambda: defaultdict(int)) for _ in range(k + 1)] for c in ("allow", "block")}
    for u in urls:
        verdict = ruled(*parse(u))[1]
        if verdict:
            text = "\2" * k + u.split("://", 1)[1] + "\3"
            for i in range(k, len(text)):
                for n in range(k + 1):
                    counts[verdict][n][text[i - n : i]][text[i]] += 1

    def chance(c, context, char):
        p = 1 / config.alphabet
        for n in range(k + 1):
            seen = counts[c][n].get(context[len(context) - n :], {})
            if seen:
                p = (seen.get(char, 0) + len(seen) * p) / (sum(seen.values()) + len(seen))
        return p

    scored = [r for r in rows if r.rule is None]
    assert scored
    for r in scored:
        text = "\2" * k + urls[r.page_id].split("://", 1)[1] + "\3"
        d = [math.log(chance("allow", text[i - k : i], text[i])) - math.log(chance("block", text[i - k : i], text[i])) for i in range(k, len(text))]
        assert r.score == pytest.approx(sum(d) / len(d), abs=1e-9)


@pytest.mark.parametrize("name", ["op3_secret_scan", "op7_url_filter"])
def test_native(spark, sf, name):
    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|InArrow", plan)
