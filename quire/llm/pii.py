"""Personal data by weak supervision, in DataFrame functions only.

*Base spans* are the leftmost non-overlapping matches of four patterns that
pass a check (address ranges, Luhn digits, digit counts); they always stay.

*Weak supervision* adds spans.  Wider patterns propose candidates; labelers --
strict pattern, check digit or range, gazetteer, words before, words after,
boundaries -- each vote yes, no or abstain on a candidate.  The votes of the
whole corpus are counted by pattern (at most a few thousand patterns exist, so
only they reach the driver); expectation-maximisation over the counts
estimates each labeler's reliability and a probability per pattern, and a
logistic span classifier is trained on those probabilities and the span's own
features.  A candidate that scores ``accept`` or more and overlaps no base span
is added.

Spans stay arrays inside their document's row: no join and no shuffle but the
pattern counts.  Positions come from the lengths of the pieces between
matches, so a text is scanned once per pattern and never searched again.

Edge cases: null text is empty; ties between kinds sort in the order email,
ip, card, phone; repeated rows and null keys get their own rows; an empty table
trains nothing and gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from quire.llm.quality import let
from quire.session import materialize

# Kinds in their order, patterns, gazetteers and cue words.
KINDS = ["email", "ip", "card", "phone"]
# Equal to [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ and so on, found
# in linear time: a run is tried from its start, or where the last match ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@|\(at\)|\[at\])"
             r"[A-Za-z0-9-]++(?:(?:\.|\(dot\)|\[dot\])[A-Za-z0-9-]++)*+",
    "ip": BASE["ip"],
    "card": BASE["card"],
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,5}\)?(?:[\x20./-][0-9]{2,5}){2,4}",
}
#: what a text must hold before a pattern is run over it; every span of BASE that
#: passes its check and every match of WIDE holds it
HINT = {"email": r"[@\(\[](?:[A-Za-z0-9-]|at[\)\]])", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]",
        "phone": r"[0-9][\x20().0-9/-]{3}"}
GAZETTEER = {
    "email": r"(?i)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$",
    "ip": r"^(?:[1-9][0-9]?|1[0-9][0-9]|2[01][0-9]|22[0-3])\.",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)",
    "phone": r"^\+?(?:1|33|34|44|49|\(?[2-9][0-9]{2}\)?[\x20.-])",
}
CUE_BEFORE = {
    "email": r"(?i)(?:e-?mail|contact|write|correo|courriel|kontakt|mailto)[\w\x20]{0,8}[:=]?[\x20<(\"]*$",
    "ip": r"(?i)(?:\bip|address|host|server|login|adresse)[\w\x20]{0,8}[:=]?[\x20<(\"]*$",
    "card": r"(?i)(?:card|visa|mastercard|amex|karte|carte|tarjeta|credit)[\w\x20]{0,8}[:=]?[\x20<(\"]*$",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|cell|handy|telefon\w*|t[eé]l[eé]phone)[\w\x20]{0,8}[:=.]?[\x20<(\"]*$",
}
CUE_AGAINST = r"(?i)(?:version|release|isbn|issn|order|invoice|chapter|page|serial|part|sku|id|no\.|nr\.|#|v|\$|€)[:=\x20]*$"
AGAINST_AFTER = r"(?i)^[\x20]*(?:%|€|\$|kg|km|cm|mm|px|mb|gb|usd|eur|times|years?)"
LABELERS = ["pattern", "check", "gazetteer", "before", "after", "edges"]

SPAN = "struct<start:int,stop:int,kind:string>"


def matches(text: Column, kind: str, pattern: str) -> Column:
    """Array of (start, stop, match, before, after) in code points."""
    def build(gaps: Column) -> Column:
        def with_found(found: Column) -> Column:
            def starts(acc, i):
                at = acc["at"] + F.length(F.get(gaps, i))
                return F.struct((at + F.length(F.get(found, i))).alias("at"),
                                F.concat(acc["all"], F.array(at)).alias("all"))
            places = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1),
                                 F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
                                 starts, lambda acc: acc["all"])
            return let(places, lambda p: F.transform(found, lambda m, i: F.struct(
                F.get(p, i).alias("start"), (F.get(p, i) + F.length(m)).alias("stop"), m.alias("match"),
                F.right(F.get(gaps, i), F.lit(24)).alias("before"),
                F.left(F.get(gaps, i + 1), F.lit(12)).alias("after"))))
        return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), with_found)

    none = F.array().cast("array<struct<start:int,stop:int,match:string,before:string,after:string>>")
    some = text.rlike(HINT[kind]) & text.rlike(pattern)
    return F.when(some, let(F.split(text, pattern, -1), build)).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    def add(total, i):
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """The base check of a match."""
    n = F.length(_digits(m))
    if kind == "ip":
        part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(n.between(12, 19), luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit("+")).when(no, F.lit("-")).otherwise(F.lit("0"))


def features(kind: str, x: Column) -> Column:
    """The labelers' votes on a candidate and its own features, as names."""
    m, n = x["match"], F.length(_digits(x["match"]))
    strict = {"email": m.rlike(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$"), "phone": m.startswith("+")}.get(kind, F.lit(True))
    inside = x["before"].rlike(r"[A-Za-z0-9._-]$") | x["after"].rlike(r"^(?:[A-Za-z0-9_]|[.,-][0-9])")
    votes = [_vote(strict, ~strict), _vote(valid(kind, m), ~valid(kind, m)),
             _vote(m.rlike(GAZETTEER[kind]), F.lit(False)),
             _vote(x["before"].rlike(CUE_BEFORE[kind]), x["before"].rlike(CUE_AGAINST)),
             _vote(F.lit(False), x["after"].rlike(AGAINST_AFTER)), _vote(~inside, inside)]
    named = [F.concat(F.lit(f"{kind}:{name}"), v) for name, v in zip(LABELERS, votes, strict=True)]
    size = F.concat(F.lit(f"{kind}:digits"), F.least(n, F.lit(20)).cast("string"))
    apart = F.concat(F.lit(f"{kind}:separated"), m.rlike(r"[0-9][^0-9]+[0-9]").cast("string"))
    return F.array(*named, size, apart)


def _proposed(kind: str, x: Column) -> Column:
    n = F.length(_digits(x["match"]))
    return {"card": n.between(12, 19), "phone": n.between(9, 15)}.get(kind, F.lit(True))


def _by_kind(kind, body):
    """``body`` with its kind bound, as the one-argument function Spark asks for."""
    return lambda x: body(kind, x)


def find(docs: DataFrame, key: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: key, ``keep``, base spans (sorted) and candidates with features."""
    d = docs.select(F.col(key).alias("key"), *[F.col(c).alias(f"keep_{c}") for c in keep],
                    F.coalesce(F.col(text), F.lit("")).alias("text"))
    base, wide = [], []
    for k in KINDS:
        d = d.withColumn(f"base_{k}", matches(F.col("text"), k, BASE[k]))
        if WIDE[k] != BASE[k]:
            d = d.withColumn(f"wide_{k}", matches(F.col("text"), k, WIDE[k]))
    for n, k in enumerate(KINDS):
        kept = F.filter(f"base_{k}", _by_kind(k, lambda k, x: valid(k, x["match"])))
        base.append(F.transform(kept, _by_kind((n, k), lambda nk, x: F.struct(
            x["start"].alias("start"), F.lit(nk[0]).alias("rank"), x["stop"].alias("stop"), F.lit(nk[1]).alias("kind")))))
        source = f"wide_{k}" if WIDE[k] != BASE[k] else f"base_{k}"
        wide.append(F.transform(F.filter(source, _by_kind(k, _proposed)), _by_kind(k, lambda k, x: F.struct(
            x["start"].alias("start"), x["stop"].alias("stop"), F.lit(k).alias("kind"),
            features(k, x).alias("features")))))
    spans = F.transform(F.array_sort(F.concat(*base)), lambda x: F.struct(
        x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind")))
    return d.select("key", *[f"keep_{c}" for c in keep], spans.alias("base"), F.concat(*wide).alias("candidates"))


# ---- reliabilities and the span classifier ----------------------------------

def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def reliabilities(patterns: list[tuple[tuple[str, ...], int]], rounds: int = 40,
                  seeds: tuple[int, ...] = ()):
    """Expectation-maximisation over counted vote patterns of one kind.

    Candidates on which all ``seeds`` labelers agree are taken as true (base
    spans).  Each pattern is its labelers' votes (names ending in ``+``, ``-``, ``0``).
    Returns the share of true spans, P(vote | truth) per labeler and vote, and
    each pattern's probability of truth.
    """
    total = sum(n for _, n in patterns)
    # a candidate is doubted until clearly more labelers are for it than against
    post = [_sigmoid(sum({"+": 1.0, "-": -1.0}.get(v[-1], 0.0) for v in votes) - 1.5) for votes, _ in patterns]
    sure = [all(votes[j][-1] == "+" for j in seeds) if seeds else False for votes, _ in patterns]
    share, table = 0.5, {}
    for _ in range(rounds):
        true = sum(p * n for p, (_, n) in zip(post, patterns, strict=True))
        share = (true + 1) / (total + 2)
        table = {}
        for j in range(len(patterns[0][0])):
            for side in (0, 1):
                for sign in "+-0":
                    mass = sum(n * (p if side else 1 - p) for p, (votes, n) in zip(post, patterns, strict=True)
                               if votes[j][-1] == sign)
                    # a labeler is taken to be better than chance: its prior says so
                    prior = 3.0 if (sign == "+") == bool(side) and sign != "0" else 1.0
                    table[j, side, sign] = (mass + prior) / ((true if side else total - true) + 5)
        post = []
        for votes, _ in patterns:
            logit = math.log(share / (1 - share))
            for j, v in enumerate(votes):  # no labeler is worse than chance; abstaining says nothing
                odds = math.log(table[j, 1, v[-1]] / table[j, 0, v[-1]])
                logit += {"+": max(0.0, odds), "-": min(0.0, odds)}.get(v[-1], 0.0)
            post.append(_sigmoid(logit))
        post = [max(p, 0.99) if s else p for p, s in zip(post, sure, strict=True)]
    return share, table, post


def train(patterns: list[tuple[list[str], int]], rounds: int = 800, rate: float = 1.0,
          ridge: float = 1e-3) -> dict[str, float]:
    """Weights of a logistic classifier over feature names, fitted to the
    probabilities that expectation-maximisation gives each pattern."""
    weights: dict[str, float] = {}
    for kind in KINDS:
        mine = [(f, n) for f, n in patterns if f and f[0].startswith(kind + ":")]
        if not mine:
            continue
        _, _, truth = reliabilities([(tuple(f[:len(LABELERS)]), n) for f, n in mine], seeds=(0, 1))
        total = sum(n for _, n in mine)
        w = dict.fromkeys({x for f, _ in mine for x in f}, 0.0)
        for _ in range(rounds):
            grad = dict.fromkeys(w, 0.0)
            for (f, n), p in zip(mine, truth, strict=True):
                miss = (p - _sigmoid(sum(w[x] for x in f))) * n / total
                for x in f:
                    grad[x] += miss
            for x in w:
                w[x] += rate * (grad[x] - ridge * w[x])
        weights |= w
    return weights


def score(found: Column, weights: dict[str, float]) -> Column:
    """The classifier's probability for a candidate's features."""
    if not weights:
        return F.lit(0.0)
    table = F.create_map(*[F.lit(v) for kv in sorted(weights.items()) for v in kv])
    total = F.aggregate(found, F.lit(0.0), lambda a, f: a + F.coalesce(F.try_element_at(table, f), F.lit(0.0)))
    return 1 / (1 + F.exp(-total))


def fit(found: DataFrame) -> dict[str, float]:
    """Count the corpus's vote patterns and train the classifier on them."""
    counted = (found.select(F.explode("candidates").alias("c")).groupBy(F.col("c.features").alias("f"))
               .agg(F.count("*").alias("n")))
    return train([(r.f, r.n) for r in counted.collect()])  # few thousand patterns at most


def pii_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", accept: float = 0.9,
              keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: ``key``, ``keep``, base (array of start, stop, kind, by start
    then kind) and spans (base and added ones, ordered alike)."""
    found = materialize(find(docs, key, text, keep), "pii")
    weights = fit(found)
    base = F.col("base")
    clear = lambda c: ~F.exists(base, lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"]))
    added = F.filter("candidates", lambda c: clear(c) & (score(c["features"], weights) >= accept))
    rank = F.create_map(*[F.lit(v) for n, k in enumerate(KINDS) for v in (k, n)])
    ranked = lambda x: F.struct(x["start"].alias("start"), F.element_at(rank, x["kind"]).alias("rank"),
                                x["stop"].alias("stop"), x["kind"].alias("kind"))
    plain = lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"))
    every = F.transform(F.array_sort(F.transform(F.concat("base", F.transform(added, plain)), ranked)), plain)
    return found.select(F.col("key").alias(key), *[F.col(f"keep_{c}").alias(c) for c in keep], "base", every.alias("spans"))


def span_list(spans: Column) -> Column:
    """``kind:start:stop`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of
    overlapping spans, the first names the whole."""
    def step(acc, s):
        more = s["start"] >= acc["at"]
        mark = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"),
                        F.when(more, F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), mark))
                        .otherwise(acc["out"]).alias("out"))
    return F.when(F.size(spans) > 0, F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))).otherwise(text)
