import random
import re

from pyspark.sql import functions as F

from trailmill.llm import secret_scan as S
from trailmill.plans.shared_store import Store

TEXTS = [
    None, "", "nothing here", "token=token:abcdefgh secret = 'hunter22'", "é password: abc123def PASSWD=zzzzzzz", "AKIA" + "A1B2" * 5 + " AKIAAKIA" + "9" * 16, "ab0123456789abcdef01234567 0123456789abcdef",
    "user=alice then host: db.example.org pwd=swordfish", "user=alice and nothing else", "see http://a.example.org only", "user=alice" + " filler" * 100 + " pwd=swordfish", "api_key=" + "k" * 9 + " " + "x" * 50_000 + " token: " + "t" * 7,
    "token=abcdefg " * 3000, "user=bob pwd=swordfish", "user=bob pwd=swordfish",
]
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def slow_base(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24])


def frame_of(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_base_spans_match_brute_force(spark):
    out = {r.doc_id: r for r in S.scanned(frame_of(spark), Store(spark, "t")).collect()}
    for i, t in enumerate(TEXTS):
        assert [tuple(s) for s in out[i].secrets.base] == slow_base(t), i
        assert {tuple(s) for s in out[i].secrets.base} <= {tuple(s) for s in out[i].secrets.spans}


def test_weak_parts_need_a_complement(spark):
    out = {r.doc_id: r.s for r in S.scanned(frame_of(spark), Store(spark, "t")).select("doc_id", S.written(F.col("secrets.spans")).alias("s")).collect()}
    kinds = lambda i: {x.split(":")[0] for x in out[i].split(",") if x}
    assert kinds(7) == {"account", "endpoint", "key"}
    assert kinds(8) == kinds(9) == kinds(10) == set()
    assert out[13] == out[14] and kinds(13) == {"account", "key"}


def test_redaction(spark):
    out = {r.doc_id: r.t for r in S.scanned(frame_of(spark), Store(spark, "t")).select("doc_id", S.redacted(F.col("text"), F.col("secrets.spans")).alias("t")).collect()}
    assert out[0] is None and out[2] == "nothing here" and out[3] == "token=token:abcdefgh [SECRET]'"
    assert out[7] == "[SECRET] then [SECRET] [SECRET]" and out[12] == "[SECRET] " * 3000


def test_redaction_of_long_texts_matches_brute_force(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(6):
        parts = [rng.choice(["é filler words \U0001F600 ", "password=abc123def ", "token: 0123456789abcdef0123456789 ", "x" * rng.randrange(3000) + " "]) for _ in range(rng.randrange(400))]
        texts.append("".join(parts))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in S.scanned(frame, Store(spark, "t")).select("*", S.redacted(F.col("text"), F.col("secrets.spans")).alias("t")).collect():
        want, at = [], 0
        for s in r.secrets.spans:
            if s.start >= at:
                want += [r.text[at : s.start], S.MARK]
            at = max(at, s.end)
        assert r.t == "".join([*want, r.text[at:]])


def test_other_columns_and_empty_table(spark, docs, empty):
    out = S.scanned(docs, Store(spark, "t"))
    assert out.columns == [*docs.columns, "secrets"] and {r._spans for r in out.collect()} == {"x"} and out.count() == docs.count()
    assert S.scanned(empty, Store(spark, "t")).count() == 0
