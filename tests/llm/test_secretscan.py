"""Secrets: base spans against ``re``, the battery and the discoveries against plain Python."""

import hashlib
import math
import random
import re
import string

import numpy as np

from sessionlens.llm import secretscan as S

SCHEMA = "doc_id long, text string, v string, n int, base string, step int"
KEYWORDS = "(password|passwd|secret|token|api_?key)"


def base(text):
    out = []
    folded = re.sub("[A-Z]", lambda m: m.group().lower(), text)
    pattern = re.compile(KEYWORDS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    at = 0
    while m := pattern.search(folded, at):
        at = m.end()
        if len(m.group(2)) >= 12:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
    return sorted(out, key=lambda x: (x[1], S.KINDS.index(x[0]), x[2]))


def shown(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def tokens(text):
    found = [m for m in re.finditer(r"[A-Za-z0-9+/_-]+={0,2}", text)]
    return [(m.start(), m.end(), m.group()) for m in found if len(m.group().rstrip("=")) >= 16 and not any(s < m.end() and m.start() < e for _, s, e in base(text))]


def upper_tail(z):
    return math.erfc(z / math.sqrt(2)) / 2


def infer(v):
    v = v.rstrip("=")
    for name, form, alphabet, folded, grouped in (
            ("hex", "([0-9a-f]+(-[0-9a-f]+)*|[0-9A-F]+(-[0-9A-F]+)*)", "0123456789abcdef", 1, 1), ("base32", "[A-Z2-7]+", string.ascii_uppercase + "234567", 0, 0),
            ("base36", "([a-z0-9]+|[A-Z0-9]+)", string.digits + string.ascii_lowercase, 1, 0), ("base62", "[A-Za-z0-9]+", string.digits + string.ascii_uppercase + string.ascii_lowercase, 0, 0),
            ("base64", "[A-Za-z0-9+/]+", string.ascii_letters[26:] + string.ascii_letters[:26] + string.digits + "+/", 0, 0),
            ("base64url", "[A-Za-z0-9_-]+", string.ascii_letters[26:] + string.ascii_letters[:26] + string.digits + "-_", 0, 0)):
        if re.fullmatch(form, v):
            core = v.replace("-", "") if grouped else v
            return name, alphabet, core.lower() if folded else core
    return None


def kind(c):
    return "d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "o"


def judged(v):
    """(encoding, n, p_uniform, p_runs, p_serial, p_text), None if there is nothing to test."""
    if not (got := infer(v)) or len(got[2]) < 16:
        return None
    name, alphabet, core = got
    n, k = len(core), len(alphabet)
    m = 12 if n >= 48 else 4
    part = np.array([x * m // k for x in range(k)])
    share = np.bincount(part, minlength=m) / k
    x = np.array([alphabet.index(c) for c in core])
    chi = (((np.bincount(part[x], minlength=m) - n * share) ** 2) / (n * share)).sum()
    p_uniform = upper_tail((np.cbrt(chi / (m - 1)) - (1 - 2 / (9 * (m - 1)))) / math.sqrt(2 / (9 * (m - 1))))
    w = [kind(c) for c in core]
    switches = sum(a != b for a, b in zip(w[1:], w, strict=False))
    shares = np.array([sum(kind(c) == j for c in alphabet) / k for j in "dluo"])
    same = (shares ** 2).sum()
    p_runs = 2 * upper_tail(abs((switches - (n - 1) * (1 - same)) / math.sqrt((n - 1) * same * (1 - same) + 2 * (n - 2) * ((shares ** 3).sum() - same ** 2))))
    y = x - x.mean()
    z = (float(y @ np.roll(y, -1)) / float(y @ y) + 1 / (n - 1)) * math.sqrt(n) if (y ** 2).sum() > 0 else math.sqrt(n)
    main = max((w.count(c), c) for c in "dluo")[1]
    own = np.bincount(part[[kind(c) == main for c in alphabet]], minlength=m)
    extra = ((own / own.sum()) ** 2 / share).sum() - 1
    zt = (m - 1 + n * extra - chi) / math.sqrt(2 * (m - 1) + 4 * n * extra)
    zs = (switches - 0.5 - (n - 1) * 0.2) / math.sqrt((n - 1) * 0.16)
    return name, n, p_uniform, p_runs, 2 * upper_tail(abs(z)), upper_tail((zt + zs) / math.sqrt(2))


def discovered(values, rate=S.RATE, level=S.LEVEL):
    rows = {v: t for v in set(values) if (t := judged(v))}
    if not rows:
        return set()
    mean = sum(t[1] for t in rows.values()) / len(rows)
    steps = {v: min(max(math.floor(-math.log10(max(t[5] * mean / t[1], 1e-60)) * 100), 0), 6000) for v, t in rows.items()}
    ok = [s for s in set(steps.values()) if 10.0 ** (-s / 100) <= rate * sum(x >= s for x in steps.values()) / len(steps)]
    return {v for v, t in rows.items() if ok and steps[v] >= min(ok) and min(t[2:5]) >= level / 3}


def rnd(r, alphabet, n):
    return "".join(r.choice(alphabet) for _ in range(n))


B62 = string.ascii_letters + string.digits
STRUCTURED = ("getUserNameFromDatabase2 this_is_a_long_identifier usr/local/share/python/lib internationalization abcdefghijklmnopqrstuvwxyz "
              "AAAAAAAAAAAAAAAAAAAAAAAA a1a1a1a1a1a1a1a1a1a1a1 2024-05-06-some-post-title 1234-5678-9012-3456 THISISALLUPPERCASE ab12ab12ab12ab12ab12ab12 "
              "Donaudampfschifffahrtsgesellschaft org/apache/spark/sql/catalyst/expressions x86_64-unknown-linux-gnu nichtschgelichber ----------------").split()


def planted(r):
    return ([rnd(r, B62, n) for n in (24, 32, 40, 64)] + [rnd(r, B62 + "+/", n) + "=" for n in (43, 64, 86)] + [rnd(r, B62 + "-_", n) for n in (32, 43)]
            + [rnd(r, string.digits + string.ascii_lowercase, 64) for _ in range(2)] + [rnd(r, "0123456789ABCDEF", 64)])


def test_base_spans_equal_re(spark):
    r = random.Random(1)
    bits = ["token", "TOKEN", "Api_Key", "apikey", "password", "paſſword", "secret", '"', "'", " ", "  ", ":", "=", "==", "AKIA", "AKIAAKIA", rnd(r, "ABCDEFGH0123", 14), "0123456789abcdef", "deadbeef",
            "-", ".", "é", "𝒜", "\x01", "\n", "abcdefghijkl", "Abc+/_.=-", "Kk", "x" * 12]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(1, 25))) for _ in range(1500)] + ["", " ", "token=" + "a" * 100_000, "0a" * 50_000 + " AKIA" + "A" * 90_000]
    df = spark.createDataFrame([(i, t, "x", 1, "x", 1) for i, t in enumerate(texts)], SCHEMA).repartition(4)
    got = {x.doc_id: x for x in S.find_secrets(df).collect()}
    for i, t in enumerate(texts):
        want = base(t.replace("\x01", "\x02"))
        assert [(x.kind, x.s, x.e) for x in got[i].base] == want, t
        assert [got[i][f"n_{k}"] for k in S.KINDS] == [sum(x[0] == k for x in want) for k in S.KINDS]


def test_the_battery_equals_plain_python(spark):
    r = random.Random(2)
    values = planted(r) + STRUCTURED + [rnd(r, r.choice([B62, "01", "ab-", "A2", "abc123", B62 + "+/-_"]), r.randrange(16, 90)) for _ in range(150)]
    got = {x.v: x for x in S.battery(spark.createDataFrame([(v,) for v in set(values)], "v string")).collect()}
    for v in set(values):
        want = judged(v)
        assert (v in got) == (want is not None), v
        if want:
            x = got[v]
            assert (x.encoding, x.n) == want[:2]
            assert np.allclose([x.p_uniform, x.p_runs, x.p_serial, x.p_text], want[2:], rtol=1e-3, atol=1e-7), v


def test_random_tokens_are_found_and_structured_ones_left_alone(spark):
    good = planted(random.Random(3))
    rows = [(i, f"see {v} here, and again ({v}).") for i, v in enumerate(good + STRUCTURED)] + [(900, "token = " + good[0]), (901, None), (902, ""), (None, good[1]), (903, good[2]), (903, good[2])]
    rows += [(904, "word " * 50_000 + good[3] + " é𝒜" * 10 + good[4])]
    df = spark.createDataFrame([(*x, "c", 0, "c", 0) for x in rows], SCHEMA).repartition(5)
    found = discovered([v for _, t in rows if t for _, _, v in tokens(t)])
    # names in camel case with a digit come closest: of what is reported, some may be structured
    assert set(good) <= found and found & set(STRUCTURED) <= {"getUserNameFromDatabase2"}
    want = sorted((str(i), shown(sorted(base(t or "") + [("random", s, e) for s, e, v in tokens(t or "") if v in found], key=lambda x: x[1]))) for i, t in rows)
    assert sorted((str(x.doc_id), ",".join(f"{y.kind}:{y.s}:{y.e}" for y in x.spans)) for x in S.find_secrets(df).collect()) == want


def test_the_query_on_whole_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    found = discovered([v for d in docs for _, _, v in tokens(d.text or "")])
    got = {x.doc_id: x for x in S.op13_secret_scan(spark, sf).collect()}
    assert len(got) == len(docs)
    for d in docs:
        b = base(d.text or "")
        more = sorted(b + [("random", s, e) for s, e, v in tokens(d.text or "") if v in found], key=lambda x: x[1])
        assert (got[d.doc_id].base_sha256, got[d.doc_id].spans) == (hashlib.sha256(shown(b).encode()).hexdigest(), shown(more))


def test_an_empty_table(spark, tmpdir_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmpdir_path}/documents.parquet")
    got = S.op13_secret_scan(spark, tmpdir_path)
    assert got.count() == 0 and got.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
