"""Base spans against Python's regular expressions; votes, estimation and classifier."""

import hashlib
import random
import re

from docflow.llm import pii
from docflow.llm.queries import QUERIES
from pyspark.sql import functions as F

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    odd = [int(c) for c in digits[::-1]]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(odd)) % 10 == 0


def valid(kind, match):
    digits = re.sub(r"[^0-9]", "", match)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in match.split(".")),
        "card": lambda: 16 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 8 <= len(digits) <= 15,
    }[kind]()


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


def spans(rows):
    return {r.doc_id: [tuple(s) for s in r.base] for r in rows}


CASES = [
    "a@b.c a@b.c%d@e.fg x@y@z.com @a.b a..b@c-d.e.f. 😀 é me@x.org",
    "1.2.3.4.5 256.1.1.1 000255.1.1.1 1.2.3.4 1.2.3 9.9.9.9.9.9.9.9 0000300.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 4111  111111111111 5 45-6 4111 1111 1111 1111 000",
    "+1 (017) 555-5036 +12345678 +1234567 ++49 30 1234567 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 +1-",
    "7" * 30_000 + " " + "a" * 30_000 + "@ " + "1." * 20_000 + " " + "1 " * 20_000 + "+" + "(" * 20_000,
    " ".join(f"u{i}@h{i}.org" for i in range(3_000)),
]


def test_base_spans_equal_python(docs_of, odd_texts):
    rng = random.Random(4)
    noise = ["".join(rng.choice("ab1.2@+- (49\n😀é") for _ in range(rng.randint(0, 120))) for _ in range(400)]
    texts = odd_texts + CASES + noise
    rows = pii.find_personal_data(docs_of(texts).repartition(4)).collect()
    assert spans(rows) == {i: brute(t) for i, t in enumerate(texts)}


def test_addresses_with_zero_parts(docs_of):
    rng = random.Random(5)
    texts = ["10.0.0.1 127.0.0.1 192.168.0.7 0.0.0.0 00.000.1.0 0.0.0.256 00255.0256.1.0 8.8.8.0 0.0.0 10.20.30.40 100.200.0100.00"]
    texts += [f"{'0' * 4_000}.{'0' * 4_000}7.{'0' * 4_000}.{'0' * 4_000}{last}" for last in ("", "255", "256")]
    texts += [".".join(rng.choice(["0", "00", "0255", "256", "10", "9", "250", "0300"]) for _ in range(rng.randint(3, 5))) for _ in range(200)]
    texts += ["".join(rng.choice("0012.. a") for _ in range(rng.randint(0, 80))) for _ in range(200)]
    want = {i: brute(t) for i, t in enumerate(texts)}
    assert [k for k, *_ in want[0]] == ["ip"] * 8 and [len(want[i]) for i in (1, 2, 3)] == [1, 1, 0]
    assert spans(pii.find_personal_data(docs_of(texts)).collect()) == want


def test_query_digests(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op4_pii"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in PATTERNS]
        assert (r.spans + ",").startswith(line + "," if line else "")


def test_added_spans_find_secrets_and_leave_words(docs_of):
    rng = random.Random(8)
    texts, want = [], {}
    for i in range(300):
        words = " ".join(rng.choice(["plain", "words", "of", "text", "internationalization-of-things"]) for _ in range(20))
        if i % 3 == 0:
            secret = "".join(rng.choice("0123456789abcdef") for _ in range(40))
            want[i] = (len(words) + 10, len(words) + 50)
            words += f' token = "{secret}" end'
        texts.append(words)
    rows = {r.doc_id: r.added for r in pii.find_personal_data(docs_of(texts)).collect()}
    assert {i: (s[0].start, s[0].end) for i, s in rows.items() if s} == want


def test_no_python_in_the_plan(docs_of):
    plan = pii.candidates(docs_of(CASES))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_estimation_learns_who_is_reliable():
    rng = random.Random(6)
    counts = {}
    for _ in range(4000):
        real = rng.random() < 0.4
        vote = lambda good: (1 if real else -1) if rng.random() < good else (-1 if real else 1)
        v = (vote(0.95), vote(0.9), vote(0.5), vote(0.85))
        counts.setdefault(v, [0, 0])[real] += 1
    posterior = pii.estimate([(v, sum(n)) for v, n in sorted(counts.items())])
    right = sum(n[int(posterior[v] >= 0.5)] for v, n in counts.items())
    assert right / 4000 > 0.93
    assert pii.estimate([]) == {}


def test_odd_tables(docs_of):
    docs = docs_of(["a@b.co", "a@b.co", None], [None, 1, 1]).withColumn("t", F.lit(1)).withColumn("base", F.lit("x")).withColumn("email", F.lit(2))
    rows = pii.find_personal_data(docs).collect()
    assert sorted(len(r.base) for r in rows) == [0, 1, 1] and all(r.added == [] for r in rows)
    assert pii.find_personal_data(docs.limit(0)).count() == 0
