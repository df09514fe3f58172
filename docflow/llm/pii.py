"""Personal data by weak supervision, in DataFrame and SQL functions alone.

Base spans follow fixed rules per kind and always stay. Further spans come from candidates of looser kinds (secrets,
account numbers, national phone numbers, names): labelers of three sorts, regular expressions, gazetteers and
context, vote for, against or not at all. Candidates are counted by what the labelers said, so expectation-maximisation
estimates how reliable each labeler is from a table whose size doesn't depend on the data; its posteriors
train a logistic span classifier over votes, kind, length and digits, whose weights become one column expression.

Patterns use possessive repeats and start only where a run starts, so a long run costs one scan of it.

Defined results
    null or empty text   no spans
    very long text       is read whole
    null doc_id          keeps its null id
    repeated rows        each row is judged alone and gets the same spans
    empty table          no rows
    no candidates        the base spans alone
    other columns        are not read
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.runtime import materialize

_LOCAL = r"[A-Za-z0-9._%+-]"
#: kind -> pattern, test that a text must pass before the pattern is tried, condition on a match ``x``.
BASE: dict[str, tuple[str, str, str]] = {
    "email": (rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(t, '@')", "true"),
    "ip": (
        r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"t rlike '[0-9][.][0-9]'",
        r"x rlike '^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?|(?<=0))(?:[.]|$)){4}$'",
    ),
    "card": (
        r"[0-9](?:[ -]?[0-9])++",
        r"t rlike '[0-9](?:[ -]?[0-9]){15}'",
        "length(translate(x, ' -', '')) between 16 and 19 and aggregate(sequence(1, length(translate(x, ' -', ''))), 0L, (q, p) -> q + "
        "if(p % 2 = 1, cast(substring(translate(x, ' -', ''), -p, 1) as int), "
        "(cast(substring(translate(x, ' -', ''), -p, 1) as int) * 2) div 10 + (cast(substring(translate(x, ' -', ''), -p, 1) as int) * 2) % 10)) % 10 = 0",
    ),
    "phone": (
        r"\+[0-9][ ().0-9-]+[0-9]",
        "contains(t, '+')",
        "length(translate(x, '+ ().-', '')) between 8 and 15",
    ),
}

#: Fixed word lists of the gazetteer labelers.
SECRET_CUES = ("token", "key", "apikey", "api_key", "secret", "password", "passwd", "pwd", "auth", "bearer")
NUMBER_CUES = ("iban", "account", "konto", "compte", "cuenta", "ssn", "social", "security")
PHONE_CUES = ("call", "phone", "tel", "telefon", "telephone", "mobile", "fax", "cell", "teléfono", "téléphone")
TITLES = ("mr", "mrs", "ms", "dr", "prof", "herr", "frau", "madame", "monsieur", "señor", "señora")
FIRST_NAMES = (
    "james", "john", "robert", "michael", "william", "david", "richard", "thomas", "mary", "patricia", "jennifer", "linda",
    "elizabeth", "barbara", "susan", "jessica", "sarah", "karen", "pierre", "jean", "marie", "nathalie", "isabelle",
    "hans", "peter", "wolfgang", "ursula", "monika", "jose", "antonio", "manuel", "carmen", "josefa",
)

_RUN = r"[A-Za-z0-9+/_-]"
#: kind -> pattern, test before it, strict form, cues in front, words that start a span of the kind.
LOOSE: dict[str, tuple[str, str, str, Sequence[str], Sequence[str]]] = {
    "secret": (rf"(?<!{_RUN}){_RUN}{{20,}}+", rf"t rlike '{_RUN}{{20}}'", "^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|(?:sk|pk|ghp|xox[bp])[-_].*)$", SECRET_CUES, ()),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "t rlike '[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}'", "^[A-Z]{2}[0-9]{2}[ A-Z0-9]{11,36}$", NUMBER_CUES, ()),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "t rlike '[0-9]{3}-[0-9]{2}-[0-9]{4}'", "^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$", NUMBER_CUES, ()),
    "local_phone": (r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9-])", "t rlike '[0-9]{3}[.-][0-9]{4}'", r"^(?:\([2-9][0-9]{2}\) |[2-9][0-9]{2}[.-])[0-9]{3}[.-][0-9]{4}$", PHONE_CUES, ()),
    "name": (
        rf"(?i)(?<![\p{{L}}])(?:{'|'.join(FIRST_NAMES)}) (?-i:\p{{Lu}})\p{{L}}++",
        f"t rlike '(?i)(?:{'|'.join(FIRST_NAMES)}) '", r"^\p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+$", TITLES, FIRST_NAMES,
    ),
}
KINDS = (*BASE, *LOOSE)
VOTES = ("form", "cue", "listed", "context", "mixture", "variety")
_BLOCK = 256


def _q(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _gate(test: str) -> str:
    return test.replace("\\", "\\\\")


def located(df: DataFrame, kind: str, pattern: str, gate: str) -> DataFrame:
    """Adds ``{kind}``: the matches in column ``t`` as start, end (code points), text and what stands around.

    Starts are sums of lengths before a match, taken by blocks so that many matches cost no square.
    """
    m, g, w, b = (f"__{kind}_{x}" for x in "mgwb")
    df = df.withColumn(m, F.expr(f"if({_gate(gate)}, regexp_extract_all(t, {_q(pattern)}, 0), array())"))
    df = df.withColumn(g, F.expr(f"if(size({m}) > 0, split(t, {_q(pattern)}, -1), array())"))
    df = df.withColumn(w, F.expr(f"transform({m}, (x, i) -> length({g}[i]) + length(x))"))
    blocks = f"sequence(0, greatest(size({w}) - 1, 0) div {_BLOCK})"
    df = df.withColumn(b, F.expr(f"transform({blocks}, k -> aggregate(slice({w}, cast(k * {_BLOCK} + 1 as int), {_BLOCK}), 0L, (s, x) -> s + x))"))
    df = df.withColumn(b, F.expr(f"transform({b}, (y, k) -> aggregate(slice({b}, 1, k), 0L, (s, x) -> s + x))"))
    start = f"{b}[cast(i div {_BLOCK} as int)] + aggregate(slice({w}, cast((i div {_BLOCK}) * {_BLOCK} + 1 as int), i % {_BLOCK}), 0L, (s, y) -> s + y) + length({g}[i])"
    spans = f"transform({m}, (x, i) -> named_struct('start', {start}, 'x', x, 'before', right({g}[i], 24), 'after', left({g}[i + 1], 1)))"
    spans = f"transform({spans}, s -> named_struct('start', s.start, 'end', s.start + length(s.x), 'x', s.x, 'before', s.before, 'after', s.after))"
    return df.withColumn(kind, F.expr(spans)).drop(m, g, w, b)


def _any(words: Sequence[str]) -> str:
    return "(?:" + "|".join(words) + ")" if words else "(?!)"


def _voted(kind: str) -> str:
    """Candidates of a kind that no base span overlaps, with votes (1 for, -1 against, 0 none) and bins."""
    _, _, form, cues, listed = LOOSE[kind]
    cue = rf"(?i)(?:^|[^\p{{L}}]){_any(cues)}[^\p{{L}}]{{0,4}}$"
    digits = "length(regexp_replace(c.x, '[^0-9]', ''))"
    votes = {
        "form": f"if(c.x rlike {_q(form)}, 1, -1)",
        "cue": f"if(c.before rlike {_q(cue)}, 1, 0)",
        "listed": f"if(lower(substring_index(c.x, ' ', 1)) in ({', '.join(map(_q, listed))}), 1, 0)" if listed else "0",
        "context": r"case when c.before rlike '[=:][ ]?[\"\']?$' then 1 when c.before rlike '[\\p{L}0-9]$' or c.after rlike '[\\p{L}0-9]' then -1 else 0 end",
        "mixture": f"case when {digits} = 0 then -1 when {digits} < length(c.x) then 1 else 0 end",
        "variety": "case when size(array_distinct(split(left(c.x, 64), ''))) >= 8 then 1 when size(array_distinct(split(left(c.x, 64), ''))) <= 3 then -1 else 0 end",
    }
    fields = ", ".join(f"'{v}', {votes[v]}" for v in VOTES)
    bins = f"'size', cast(least(length(c.x) div 12, 4) as int), 'digits', cast(4 * {digits} div length(c.x) as int)"
    apart = "not exists(base, b -> b.start < c.end and c.start < b.end)"
    return f"transform(filter({kind}, c -> {apart}), c -> named_struct('kind', '{kind}', 'start', c.start, 'end', c.end, {fields}, {bins}))"


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, base, loose``: base spans (kind, start, end) in their order, voted candidates of the other kinds."""
    df = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("t"))
    for kind, (pattern, gate, condition) in BASE.items():
        df = located(df, kind, pattern, gate)
        kept = f"transform(filter({kind}, s -> {_on(condition)}), s -> named_struct('kind', '{kind}', 'start', s.start, 'end', s.end))"
        df = df.withColumn(kind, F.expr(kept))
    df = df.withColumn("base", F.concat(*BASE)).drop(*BASE)
    for kind, (pattern, gate, *_) in LOOSE.items():
        df = located(df, kind, pattern, gate)
        df = df.withColumn(kind, F.expr(_voted(kind)))
    return df.select("doc_id", "base", F.concat(*LOOSE).alias("loose"))


def _on(condition: str) -> str:
    """The condition on a match, as SQL text on the span ``s``."""
    return re.sub(r"\bx\b", "s.x", _gate(condition))


def estimate(counts: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> dict[tuple[int, ...], float]:
    """Posterior that a candidate with these votes is real, by expectation-maximisation.

    Each labeler has its own chances of each vote for real and for other spans; votes count as independent.
    """
    posterior = {v: 1 / (1 + math.exp(-sum(v))) for v, _ in counts}
    if not counts:
        return posterior
    width = len(counts[0][0])
    for _ in range(rounds):
        real = sum(n * posterior[v] for v, n in counts)
        total = sum(n for _, n in counts)
        prior = (real + 1) / (total + 2)
        chance = []
        for k in range(width):
            table = {}
            for vote in (-1, 0, 1):
                yes = sum(n * posterior[v] for v, n in counts if v[k] == vote)
                some = sum(n for v, n in counts if v[k] == vote)
                table[vote] = ((yes + 0.5) / (real + 1.5), (some - yes + 0.5) / (total - real + 1.5))
            chance.append(table)
        for v in posterior:
            margin = math.log(prior / (1 - prior))
            margin += sum(math.log(chance[k][v[k]][0] / chance[k][v[k]][1]) for k in range(width))
            posterior[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, margin))))
    # The voters are right more often than not: the class they vote for is the real one.
    real = sum(n * p for (v, n), p in zip(counts, (posterior[v] for v, _ in counts), strict=True))
    lean = sum(n * posterior[v] * sum(v) for v, n in counts) / max(real, 1e-9)
    other = sum(n * (1 - posterior[v]) * sum(v) for v, n in counts) / max(sum(n for _, n in counts) - real, 1e-9)
    return posterior if lean >= other else {v: 1 - p for v, p in posterior.items()}


#: One input of the span classifier: field of a candidate and the value that it must have.
INPUTS = [(v, s) for v in VOTES for s in (-1, 1)] + [("kind", k) for k in LOOSE] + [("size", k) for k in range(5)] + [("digits", k) for k in range(5)]


def train(rows: list[tuple[dict, int, float]], steps: int = 300, ridge: float = 1e-3) -> list[float]:
    """Weights of ``INPUTS`` and intercept of a logistic classifier: rows of fields, count, posterior."""
    weights = [0.0] * (len(INPUTS) + 1)
    total = sum(n for _, n, _ in rows) or 1
    active = [([k for k, (f, v) in enumerate(INPUTS) if row[f] == v] + [len(INPUTS)], n / total, p) for row, n, p in rows]
    width = max((len(a) for a, _, _ in active), default=1)
    for _ in range(steps):
        gradient = [ridge * w for w in weights]
        for on, share, p in active:
            guess = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights[k] for k in on)))))
            for k in on:
                gradient[k] += share * (guess - p)
        weights = [w - 4 / width * 2 * g for w, g in zip(weights, gradient, strict=True)]
    return weights


def span_classifier(found: DataFrame) -> list[float] | None:
    """Fit to all candidates of ``found``; at most one row per combination of votes and bins reaches the driver."""
    c = found.select(F.explode("loose").alias("c")).select("c.*")
    rows = c.groupBy("kind", *VOTES, "size", "digits").agg(F.count(F.lit(1)).alias("n")).orderBy("kind", *VOTES, "size", "digits").collect()
    if not rows:
        return None
    counts: dict[tuple[int, ...], int] = {}
    for r in rows:
        key = tuple(r[v] for v in VOTES)
        counts[key] = counts.get(key, 0) + r["n"]
    posterior = estimate(sorted(counts.items()))
    return train([(r.asDict(), r["n"], posterior[tuple(r[v] for v in VOTES)]) for r in rows])


def _accepted(c: Column, weights: list[float]) -> Column:
    """Whether the classifier takes a candidate for real."""
    margin = F.lit(weights[-1])
    for (field, value), w in zip(INPUTS, weights, strict=False):
        margin = margin + F.when(c[field] == F.lit(value), F.lit(w)).otherwise(F.lit(0.0))
    return margin >= 0


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, base, added`` for every row: arrays of spans (kind, start, end), end exclusive, in code points."""
    found = materialize(candidates(docs), "pii-candidates")
    weights = span_classifier(found)
    if weights is None:
        added = F.expr("array()").cast("array<struct<kind:string,start:bigint,end:bigint>>")
    else:
        kept = F.filter("loose", lambda c: _accepted(c, weights))
        added = F.transform(kept, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return found.select("doc_id", "base", added.alias("added"))
