"""Personal data by weak supervision, in DataFrame functions only.

Base patterns always count. Wider patterns propose further spans; on every proposal a format
check, gazetteers and the words before it vote. Expectation-maximisation over the counts of
vote patterns estimates how reliable each labeler is, without any label. Its posteriors are
the aims of a logistic classifier over what a span and its surroundings look like (length,
share of digits, separators, neighbouring characters, words before and after), which accepts
or rejects the proposals. A fifth of the proposals is held out to choose its penalty.
"""

from __future__ import annotations

import itertools
import math
import operator
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, empty_if_null
from .fingerprints import let

KINDS = ("email", "ip", "card", "phone")

# Fixed values of the base patterns. ``(?:(?<!x)|\G)`` only skips starts that cannot succeed,
# inside a run whose first start failed; the possessive forms match what the greedy ones do.
_LOCAL = r"A-Za-z0-9._%+-"
_LABEL = r"A-Za-z0-9-"
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[{_LABEL}]++\.[{_LABEL}](?:(?!\.(?![{_LABEL}]))[{_LABEL}.])*+",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:(?![\x20-](?![0-9]))[0-9\x20-])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider patterns of the same kinds, from which further spans may come.
WIDER = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}+ ?[\[(](?:at|AT)[\])] ?[{_LABEL}]{{1,63}} ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z]{{2,24}}",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:.])",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,14}(?![\x20-]?[0-9])",
    "phone": r"(?<![0-9A-Za-z+.()-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{4}(?![0-9A-Za-z-])",
}
#: Words before a span that speak for its kind, and words that speak against personal data.
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|courriel|correo|kontakt)\b",
    "ip": r"(?i)\b(?:ip|ipv6|host|server|address|login|adresse|client)\b",
    "card": r"(?i)\b(?:card|visa|amex|mastercard|credit|debit|payment|carte|karte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|fax|mobile|cell|whatsapp|telefon|t[ée]l[ée]phone|tel[ée]fono)\b",
}
AGAINST = r"(?i)\b(?:isbn|issn|doi|order|invoice|version|serial|part|sku|ticket|page|id|no|nr|ref)\b[ .:#]*$"
#: Gazetteers: common top-level domains, first digits of card networks, area codes never given out.
GAZETTEERS = {
    "email": r"(?i)(?:com|org|net|edu|gov|io|de|fr|es|uk|info)$",
    "ip": r"^(?:[23][0-9A-Fa-f]{3}|[Ff][CcDdEe][0-9A-Fa-f]{2}):",
    "card": r"^(?:4|5[1-5]|3[47]|36|6011|65|2[2-7])",
    "phone": r"^\(?(?:0[1-9]|[2-9])[0-9]",
}
LABELERS = ("format", "gazetteer", "context", "against")
#: How often a labeler that votes is held to be right at first; counts as ten votes.
BELIEFS = (0.8, 0.7, 0.9, 0.96)
#: Code points before a span that the context labelers see, and after it the classifier; other proposals of the kind end it.
CONTEXT = 40
#: Probability from which a proposal is accepted.
LEAST = 0.7
#: What the classifier sees of a span, and how many values each has.
FEATURES = {
    "length": 4, "digits": 4, "separators": 5, "before": 5, "after": 5, "introduced": 2, "cue_before": 2, "cue_after": 2, "against": 2, "gazetteer": 2,
}
#: Penalties that the held-out proposals choose from.
PENALTIES = (0.3, 1.0, 3.0, 10.0)
_SPAN = "struct<kind:int,start:int,end:int,match:string>"
#: Sums that are appended one by one.
_BLOCK = 512


def _running(values: Column, op: Callable[[Column, Column], Column], first: int) -> Column:
    """``op`` over an array from its start up to each place, by blocks when it is long; ``first`` has no effect on it."""

    def appended(a: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("all"), F.lit(first).alias("last"))
        return F.aggregate(
            a, start, lambda s, x: F.struct(F.array_append(s["all"], op(s["last"], x)).alias("all"), op(s["last"], x).alias("last")), lambda s: s["all"]
        )

    def in_blocks(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / _BLOCK).cast("int")), lambda b: appended(F.slice(a, b * _BLOCK + 1, _BLOCK)))

        def joined(inner: Column) -> Column:
            ahead = appended(F.transform(inner, lambda x: F.element_at(x, -1)))
            return let(ahead, lambda done: F.flatten(F.transform(inner, lambda x, j: F.transform(x, lambda v: op(F.coalesce(F.get(done, j - 1), F.lit(first)), v)))))

        return let(blocks, joined)

    return let(values, lambda a: F.when(F.size(a) <= _BLOCK, appended(a)).otherwise(in_blocks(a)))


def _matches(text: Column, pattern: str, kind: int, context: bool = False) -> Column:
    """Spans of all matches in code points, from the text between them.

    With ``context``, structs of the span and of up to CONTEXT code points before and after
    it, as far as the next match of the pattern on either side.
    """

    def located(found: Column, pieces: Column) -> Column:
        steps = F.transform(found, lambda m, i: F.length(F.get(pieces, i)) + F.length(m))
        spans = let(
            _running(steps, operator.add, 0),
            lambda ends: F.zip_with(
                ends, found, lambda e, m: F.struct(F.lit(kind).alias("kind"), (e - F.length(m)).alias("start"), e.alias("end"), m.alias("match"))
            ),
        )
        if not context:
            return spans
        before, after = (lambda i: F.substring(F.get(pieces, i), -CONTEXT, CONTEXT)), (lambda i: F.substring(F.get(pieces, i + 1), 1, CONTEXT))
        return F.transform(spans, lambda s, i: F.struct(s.alias("span"), before(i).alias("before"), after(i).alias("after")))

    none = F.array().cast(f"array<struct<span:{_SPAN},before:string,after:string>>" if context else f"array<{_SPAN}>")
    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda found: F.when(F.size(found) > 0, let(F.split(text, pattern, -1), lambda pieces: located(found, pieces))).otherwise(none),
    )


def _none() -> Column:
    return F.array().cast(f"array<{_SPAN}>")


def _luhn(digits: Column) -> Column:
    values = F.transform(F.split(F.reverse(digits), ""), lambda d: d.try_cast("int"))
    summed = F.aggregate(
        F.transform(
            F.filter(values, lambda v: v.isNotNull()), lambda v, i: F.when(i % 2 == 0, v).when(v > 4, 2 * v - 9).otherwise(2 * v)
        ),
        F.lit(0),
        lambda s, v: s + v,
    )
    return summed % 10 == 0


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _kept(kind: str, span: Column) -> Column:
    """The base rule for a match of each kind."""
    match = span["match"]
    if kind == "ip":
        parts = F.split(match, r"\.")
        return F.forall(parts, lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.substring(p, -3, 3).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return let(_digits(match), lambda d: F.length(d).between(16, 19) & F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """The spans of all base patterns that pass, by kind, then start."""
    present = {"email": "@", "ip": ".", "card": None, "phone": "+"}
    each = []
    for i, kind in enumerate(KINDS):
        found = F.filter(_matches(text, BASE[kind], i), partial(_kept, kind))
        each.append(found if present[kind] is None else F.when(F.instr(text, present[kind]) > 0, found).otherwise(_none()))
    return F.concat(*each)


def _apart(found: Column, base: Column) -> Column:
    """The elements of ``found`` whose span touches none of ``base``, in one pass over both in order of their starts."""
    far = (1 << 31) - 1

    def merged(both: Column) -> Column:
        reach = _running(F.transform(both, lambda x: F.when(x["own"] < 0, x["end"]).otherwise(0)), lambda a, b: F.greatest(a, b), 0)
        ahead = F.reverse(_running(F.transform(F.reverse(both), lambda x: F.when(x["own"] < 0, x["start"]).otherwise(far)), lambda a, b: F.least(a, b), far))

        def free(limits: Column) -> Column:
            alone = F.filter(both, lambda x, i: (x["own"] >= 0) & (F.get(limits["reach"], i) <= x["start"]) & (F.get(limits["ahead"], i) >= x["end"]))
            return F.transform(alone, lambda x: F.get(found, x["own"]))

        return let(F.struct(reach.alias("reach"), ahead.alias("ahead")), free)

    # A base span comes first among spans with one start.
    ours = F.transform(found, lambda f, i: F.struct(f["span"]["start"].alias("start"), i.cast("int").alias("own"), f["span"]["end"].alias("end")))
    theirs = F.transform(base, lambda s: F.struct(s["start"].alias("start"), F.lit(-1).alias("own"), s["end"].alias("end")))
    return F.when((F.size(found) == 0) | (F.size(base) == 0), found).otherwise(let(F.array_sort(F.concat(theirs, ours)), merged))


_PROPOSAL = f"struct<span:{_SPAN},votes:array<int>,features:array<int>>"


def proposals(text: Column, base: Column) -> Column:
    """Spans of the wider patterns that touch no base span, each with its votes of 1, 0 or -1 and its features."""
    present = {"email": r"[\[(](?i:at)[\])]", "ip": "[0-9A-Fa-f]:[0-9A-Fa-f]", "card": r"[0-9][\x20-]?[0-9]{3}", "phone": r"[0-9]{2}\)?[ .-][0-9]{3}"}
    each = []
    for i, kind in enumerate(KINDS):
        apart = let(_matches(text, WIDER[kind], i, context=True), lambda found: _apart(found, base))
        voted = F.transform(apart, partial(_voted, kind))
        each.append(F.when(text.rlike(present[kind]), voted).otherwise(F.array().cast(f"array<{_PROPOSAL}>")))
    return F.concat(*each)


def _voted(kind: str, found: Column) -> Column:
    span = found["span"]
    match = span["match"]
    checked = {
        "email": F.length(match) >= 10,
        "ip": F.size(F.split(match, ":")) == 8,
        "card": let(_digits(match), lambda d: (F.length(d) == 15) & _luhn(d)),
        "phone": F.length(_digits(match)).between(9, 12),
    }[kind]

    def described(seen: Column) -> Column:
        checks = [seen["format"], seen["gazetteer"], seen["cue"], seen["against"]]
        votes = [F.when(checks[0], 1).otherwise(-1), F.when(checks[1], 1).otherwise(-1), F.when(checks[2], 1).otherwise(0), F.when(checks[3], -1).otherwise(0)]
        digits = F.length(_digits(match)) / F.length(match)
        kinds_of_gap = F.regexp_replace(match, r"[^ .\-]", "")
        gap = (
            F.when(kinds_of_gap == "", 0).when(kinds_of_gap.rlike("^ +$"), 1).when(kinds_of_gap.rlike("^-+$"), 2).when(kinds_of_gap.rlike(r"^\.+$"), 3).otherwise(4)
        )

        def neighbour(c: Column) -> Column:
            return F.when((c == "") | c.rlike(r"^\s$"), 0).when(c.rlike(r"^\p{L}$"), 1).when(c.rlike("^[0-9]$"), 2).when(c.rlike("^[.,;!?]$"), 3).otherwise(4)

        features = [
            F.when(F.length(match) <= 12, 0).when(F.length(match) <= 16, 1).when(F.length(match) <= 24, 2).otherwise(3),
            F.when(digits < 0.25, 0).when(digits < 0.5, 1).when(digits < 0.75, 2).otherwise(3),
            gap, neighbour(F.substring(seen["before"], -1, 1)), neighbour(F.substring(seen["after"], 1, 1)),
            seen["before"].rlike(r"[:=#]\s*$").cast("int"), seen["cue"].cast("int"), seen["after"].rlike(CUES[kind]).cast("int"), seen["against"].cast("int"),
            seen["gazetteer"].cast("int"),
        ]
        return F.struct(span.alias("span"), F.array(*votes).alias("votes"), F.array(*features).alias("features"))

    seen = F.struct(
        F.coalesce(checked, F.lit(False)).alias("format"), match.rlike(GAZETTEERS[kind]).alias("gazetteer"), found["before"].rlike(CUES[kind]).alias("cue"),
        found["before"].rlike(AGAINST).alias("against"), found["before"].alias("before"), found["after"].alias("after"),
    )
    return let(seen, described)


@dataclass(frozen=True)
class SpanModel:
    """For each kind the final classifier (a bias, and a weight for each value of each feature) and the labelers' estimated reliabilities."""

    bias: tuple[float, ...]
    weights: tuple[tuple[tuple[float, ...], ...], ...]
    reliabilities: tuple[tuple[float, ...], ...]
    #: Cross-entropy of the held-out proposals, before and after training; None without any.
    losses: tuple[tuple[float, float] | None, ...]

    def score(self, kind: int, features: tuple[int, ...]) -> float:
        return self.bias[kind] + sum(w[v] for w, v in zip(self.weights[kind], features, strict=True))

    def accepts(self, kind: Column, features: Column, least: float = LEAST) -> Column:
        """As a Column, so that it runs where the spans are."""
        own = F.get(F.array(*[F.array(*[F.array(*[F.lit(x) for x in w]) for w in each]) for each in self.weights]), kind)
        score = F.get(F.array(*[F.lit(b) for b in self.bias]), kind)
        for j in range(len(FEATURES)):
            score = score + F.get(F.get(own, F.lit(j)), F.get(features, F.lit(j)))
        return score >= math.log(least / (1 - least))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def posteriors(votes: np.ndarray, n: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, list[float]]:
    """Expectation-maximisation over vote patterns: what each row of votes is worth, and each labeler's reliability.

    A labeler that votes is right with one probability, whichever way it votes. Ten votes as
    believed at first are added, so that few proposals change little.
    """
    right, prior = np.array(BELIEFS), 0.5
    for _ in range(rounds):
        p = _sigmoid(math.log(prior / (1 - prior)) + votes @ np.log(right / (1 - right)))
        prior = float(np.clip((5 + (p * n).sum()) / (10 + n.sum()), 0.02, 0.98))
        hits = (n[:, None] * np.where(votes > 0, p[:, None], 1 - p[:, None]) * (votes != 0)).sum(axis=0)
        right = np.clip((10 * np.array(BELIEFS) + hits) / (10 + (n[:, None] * (votes != 0)).sum(axis=0)), 0.51, 0.995)
    return _sigmoid(math.log(prior / (1 - prior)) + votes @ np.log(right / (1 - right))), right.tolist()


def _one_hot(features: np.ndarray) -> np.ndarray:
    """A bias and a column for each value of each feature; -1 stands for no value."""
    out = [np.ones((len(features), 1))]
    for j, values in enumerate(FEATURES.values()):
        out.append((features[:, j : j + 1] == np.arange(values)[None, :]).astype(float))
    return np.hstack(out)


def _fit_logistic(x: np.ndarray, aims: np.ndarray, n: np.ndarray, penalty: float, steps: int = 25) -> np.ndarray:
    """Logistic regression on probabilities as aims, by Newton's method from zero; the bias isn't penalised."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-3
    for _ in range(steps):
        p = _sigmoid(x @ w)
        gradient = x.T @ (n * (p - aims)) + ridge * w
        curvature = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curvature, gradient)
        w -= step * min(1.0, 3 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _loss(x: np.ndarray, aims: np.ndarray, n: np.ndarray, w: np.ndarray) -> float:
    p = np.clip(_sigmoid(x @ w), 1e-9, 1 - 1e-9)
    return float(-(n * (aims * np.log(p) + (1 - aims) * np.log(1 - p))).sum() / n.sum())


def _believed() -> tuple[np.ndarray, np.ndarray]:
    """Features and aims of one made-up proposal for each vote pattern as it is believed at first; without a shape."""
    rows, aims = [], []
    for pattern in itertools.product((1, -1), (1, -1), (1, 0), (0, -1)):
        by_name = {"gazetteer": pattern[1] > 0, "cue_before": pattern[2] > 0, "against": pattern[3] < 0}
        rows.append([int(by_name[f]) if f in by_name else -1 for f in FEATURES])
        aims.append(1 / (1 + math.exp(-sum(v * math.log(r / (1 - r)) for v, r in zip(pattern, BELIEFS, strict=True)))))
    return np.array(rows), np.array(aims)


def learn(counts: list[tuple[int, tuple[int, ...], tuple[int, ...], bool, int]]) -> SpanModel:
    """Expectation-maximisation, then the classifier, from rows of kind, votes, features, held out, count.

    There are at most as many rows as vote patterns times feature values, whatever the size of the corpus.
    """
    bias, weights, reliabilities, losses = [], [], [], []
    prior_x, prior_aims = _believed()
    prior_x = _one_hot(prior_x)
    for kind in range(len(KINDS)):
        rows = [r for r in counts if r[0] == kind]
        votes = np.array([r[1] for r in rows], dtype=float).reshape(-1, len(LABELERS))
        n = np.array([r[4] for r in rows], dtype=float)
        held = np.array([r[3] for r in rows], dtype=bool)
        aims, right = posteriors(votes, n)
        x = _one_hot(np.array([r[2] for r in rows], dtype=int).reshape(-1, len(FEATURES)))
        train = np.vstack([prior_x, x[~held]]), np.concatenate([prior_aims, aims[~held]]), np.concatenate([np.ones(len(prior_aims)), n[~held]])
        fitted = [_fit_logistic(*train, penalty) for penalty in PENALTIES]
        if held.any():
            after, best = min((_loss(x[held], aims[held], n[held], w), i) for i, w in enumerate(fitted))
            losses.append((_loss(x[held], aims[held], n[held], np.zeros(x.shape[1])), after))
        else:
            best = 1
            losses.append(None)
        w, at, own = fitted[best], 1, []
        for values in FEATURES.values():
            own.append(tuple(w[at : at + values].tolist()))
            at += values
        bias.append(float(w[0]))
        weights.append(tuple(own))
        reliabilities.append(tuple(right))
    return SpanModel(tuple(bias), tuple(weights), tuple(reliabilities), tuple(losses))


def fit(proposed: DataFrame) -> SpanModel:
    """The model of a DataFrame whose column ``proposals`` holds voted proposals."""
    held = F.pmod(F.xxhash64("p.span.match", "p.span.start"), F.lit(5)) == 0
    counted = (
        proposed.where(F.size("proposals") > 0)
        .select(F.explode("proposals").alias("p"))
        .groupBy(F.col("p.span.kind").alias("kind"), F.col("p.votes").alias("votes"), F.col("p.features").alias("features"), held.alias("held"))
        .agg(F.count("*").alias("n"))
    )
    rows = [(r["kind"], tuple(r["votes"]), tuple(r["features"]), r["held"], r["n"]) for r in counted.collect()]
    return learn(sorted(rows))


def _found(docs: DataFrame, column: str = "text") -> DataFrame:
    """Adds base and proposals to a DataFrame with a column of texts."""
    text = empty_if_null(column)
    both = let(base_spans(text), lambda b: F.struct(b.alias("base"), proposals(text, b).alias("proposals")))
    return docs.withColumn("found", both).withColumn("base", F.col("found.base")).withColumn("proposals", F.col("found.proposals")).drop("found")


def _all_spans(model: SpanModel) -> Column:
    """Base spans and accepted proposals, by kind, then start."""
    more = F.transform(F.filter("proposals", lambda p: model.accepts(p["span"]["kind"], p["features"])), lambda p: p["span"])
    return F.when(F.size("proposals") == 0, F.col("base")).otherwise(F.array_sort(F.concat(F.col("base"), more)))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(kind: int, span: Column) -> Column:
    return span["kind"] == kind


def detected(docs: DataFrame) -> DataFrame:
    """Counts of base spans by kind, their hash, and all spans of every whole text.

    Null text counts as empty. Offsets are code points, ends exclusive. Spans of different
    kinds may overlap; added spans touch no base span. Repeated rows give repeated results,
    an empty table an empty one; null ids stay null; extra columns have no effect.
    """
    plain = docs.select(F.col("doc_id").cast("long"), empty_if_null("text").cast("string").alias("text"))
    found = checkpointed(_found(plain).select("doc_id", "base", "proposals"))
    model = fit(found)
    counts = [F.size(F.filter("base", partial(_of_kind, i))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(_all_spans(model)).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by the name of its kind in brackets, all columns kept.

    Overlapping spans become one replacement, named after the first. n_chars, where there is
    such a column, is counted anew; null texts stay null; repeated rows stay; an empty table
    gives an empty result. Texts are scanned once and kept with their spans while the model
    is fitted.
    """
    # Own names for all columns: extra ones may be called like those that are added here.
    named = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    at = docs.columns.index("text")
    named = named.withColumn(f"c{at}", F.col(f"c{at}").cast("string"))
    whole = F.coalesce(F.col(f"c{at}"), F.lit(""))
    found = checkpointed(_found(named, f"c{at}"))
    model = fit(found)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def replaced(spans: Column) -> Column:
        def pieces(reach: Column) -> Column:
            def piece(s: Column, i: Column) -> Column:
                done = F.coalesce(F.get(reach, i - 1), F.lit(0))
                return F.when(s["start"] >= done, F.concat(F.substring(whole, done + 1, s["start"] - done), F.get(names, s["kind"]))).otherwise("")

            return F.concat(F.array_join(F.transform(spans, piece), ""), F.substring(whole, F.element_at(reach, -1) + 1, F.length(whole)))

        return let(_running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b), 0), pieces)

    by_start = F.array_sort(F.transform(_all_spans(model), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    untouched = F.size(F.col("base")) + F.size(F.col("proposals")) == 0
    clean = F.when(untouched, F.col(f"c{at}")).otherwise(let(by_start, lambda s: F.when(F.size(s) == 0, F.col(f"c{at}")).otherwise(replaced(s))))
    done = found.withColumn(f"c{at}", clean)
    n_chars = F.length(f"c{at}")
    return done.select(*[(n_chars.cast(docs.schema[c].dataType) if c == "n_chars" else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)])
