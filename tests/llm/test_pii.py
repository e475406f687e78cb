import hashlib
import random
import re

from sluice.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            v = m.group()
            d = re.sub("[^0-9]", "", v)
            if kind == "ip" and any(int(x) > 255 for x in v.split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and pii.luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def texts():
    rng = random.Random(4)
    out = ["", None, "a@b.c%d@e.f", "1.2.3.4.5.6.7.8", "001.255.0.000 256.1.1.1 1.2.3", "4111 1111-1111 1111", "41111111111111111111", "+1 (555) 555-0100.", "é😀 x@y.zz, 🎉+49 170 1234567"]
    out += ["0" * 30_000, "a." * 20_000 + "@b.cc", "1 " * 20_000, "+1" + " " * 20_000 + "2", "x@" * 5000, "a@b.c " * 1000, "12345678901234567890." * 500]
    for alphabet in ("a@.-1 ", "0123456789 -", "0123456789.", "+0123 ()-.", "aZ9_%+-@."):
        out += ["".join(rng.choices(alphabet, k=rng.randint(1, 120))) for _ in range(150)]
    digits = ["".join(rng.choices("0123456789", k=rng.randint(11, 20))) for _ in range(200)]
    out += [f"pay {d} now" for d in digits]
    return out


def test_base_against_brute_force(spark, tmp_path):
    rows = list(enumerate(texts()))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op5_pii(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = brute(t)
        r = got[i]
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(x.startswith(f"{k}:") for x in want) for k in PATTERNS], repr(t)[:200]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), repr(t)[:200]
        assert set(want) <= set(r.spans.split(","))


def test_features_are_the_same(spark):
    rng = random.Random(1)
    made = [pii._example(rng) for _ in range(150)]
    rows = spark.createDataFrame([(i, *m) for i, m in enumerate(made)], "i int, kind string, v string, before string, after string, y int")
    from pyspark.sql import functions as F

    for kind in pii.KINDS:
        c = F.struct("v", "before", "after")
        got = rows.filter(F.col("kind") == kind).select("i", F.array(*(x.cast("int") for x in pii._feature_columns(kind, c).values())).alias("f"), F.array(*(F.lit(n) for n in pii._feature_columns(kind, c))).alias("n")).collect()
        for r in got:
            assert dict(zip(r.n, r.f)) == dict(zip(pii.FEATURES, pii.feature_row(*made[r.i][:4])))


def test_added_spans(spark, tmp_path):
    rows = [(1, "my ssn: 123-45-6789 ok"), (2, "order 123-45-6789"), (3, "write to joe [at] site [dot] org please"), (4, 'token = "40ba077d62935af6fd437e967f92c02cca956b74" x'), (5, "call 555-123-4567 now"), (6, "Plain words only, from 2024 to 2025.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.spans for r in queries.op5_pii(spark, str(tmp_path)).collect()}
    assert got[1] == "ssn:8:19" and got[2] == "" and got[3] == "email:9:32" and got[4] == "secret:9:49" and got[5] == "phone:5:17" and got[6] == ""


def redacted(text, spans):
    """The text with spans, given as kind:start:end, replaced."""
    found = sorted((int(a), -int(b), k) for k, a, b in (x.split(":") for x in spans.split(",") if x))
    joined = []
    for a, b, k in found:
        if joined and a < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], -b)
        else:
            joined.append([a, -b, k])
    for a, b, k in reversed(joined):
        text = f"{text[:a]}<{k}>{text[b:]}"
    return text


def test_redact_and_empty(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a@b.cc and 1.2.3.4, 300.1.1.1"), (2, None), (3, "ssn: 123-45-6789, joe [at] site [dot] org, call 555-123-4567")], "doc_id long, text string")
    assert [r.text for r in pii.redact(docs).orderBy("doc_id").collect()] == ["<email> and <ip>, 300.1.1.1", None, "ssn: <ssn>, <email>, call <phone>"]
    assert pii.find_personal_data(docs.limit(0)).count() == 0 and pii.redact(docs.limit(0)).count() == 0
    assert pii.find_personal_data(docs.selectExpr("doc_id", "text", "1 AS id", "2 AS p_email")).count() == 2 + 1
    clashing = docs.selectExpr("doc_id", "text", "1 AS own", "2 AS spans", "3 AS n")
    assert pii.redact(clashing).columns == clashing.columns
    rows = [(i, t) for i, t in enumerate(texts()) if t is not None] + [(9000, "é😀" * 3000 + " x@y.zz " + "ü" * 2000 + " 4111 1111-1111 1111 " + "z" * 1023 + " 1.2.3.4")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spans = {r.doc_id: r.spans for r in queries.op5_pii(spark, str(tmp_path)).collect()}
    got = {r.doc_id: r.text for r in pii.redact(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    assert all(got[i] == redacted(t, spans[i]) for i, t in rows)


def test_added_spans_of_the_table(spark):
    """Recall on the tokens that the documents hold, and what else is added to clean numbers and words."""
    sf = "/root/testdata/sf0.01"
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    caught = missed = other = 0
    for r in queries.op5_pii(spark, sf).collect():
        want = {f"secret:{m.start(1)}:{m.end(1)}" for m in re.finditer(r'token = "([0-9a-f]{40})"', text[r.doc_id])}
        added = set(r.spans.split(",")) - set(brute(text[r.doc_id])) - {""}
        caught, missed, other = caught + len(want & added), missed + len(want - added), other + len(added - want)
    print("tokens caught", caught, "missed", missed, "other added spans", other)
    assert caught >= 10 and missed == 0 and other <= 0.1 * caught
