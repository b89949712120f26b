"""Personal data by weak supervision, in DataFrame functions only.

Regex, validity, gazetteer and context labelers vote on candidate spans;
expectation-maximisation over the counts of vote patterns estimates how reliable each is,
and a logistic span classifier is trained on the resulting soft labels.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedloom.llm.common import scratch

#: The last kind has no base pattern: credentials, which only the method finds. They are kept apart from the spans of the other kinds.
KINDS = ("email", "ip", "card", "phone", "secret")
# The contract's patterns in forms that Java matches in linear time. A run
# of the leading class is entered at its start or where the last match ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Looser forms, which only the trained classifier can turn into spans.
LOOSE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]{1,64}+\x20?[(\[{]\x20?(?:at|AT)\x20?[)\]}]\x20?[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[(\[{]\x20?(?:dot|DOT)\x20?[)\]}]\x20?)[A-Za-z0-9-]{1,63}+)+",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:[(\[](?:\.|dot)[)\]][0-9]{1,3}){3}(?![0-9])|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20._/-]{1,2}[0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+().-])(?:(?:\([0-9]{2,4}\)|[0-9]{3,4})[\x20.-]{1,2}[0-9]{3,4}[\x20.-][0-9]{3,4}|00[1-9][0-9](?:[\x20-]?[0-9]){6,11})(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_/+=-])(?=[A-Za-z_/+=-]{0,99}[0-9])(?=[0-9_/+=-]{0,99}[A-Za-z])[A-Za-z0-9_/+=-]{20,}+",
}
#: What a text must hold before a pattern is tried.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
LOOSE_NEEDS = {
    "email": r"[(\[{]\x20?(?:at|AT)\x20?[)\]}]", "ip": r"[0-9][(\[](?:\.|dot)[)\]][0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", "card": r"[0-9]{4}[\x20._/-]{1,2}[0-9]{4}",
    "phone": r"[0-9][\x20.-][0-9]{3,4}(?![0-9])|00[1-9][0-9]", "secret": r"[A-Za-z0-9_/+=-]{20}",
}
# Gazetteers of common top-level domains, card number beginnings, country codes and beginnings of credentials.
DOMAINS = "com org net edu gov info biz io de fr es it nl uk us eu ca au ch at be pl br jp cn in".split()
CARD_STARTS = "^(?:4|5[1-5]|2[2-7]|3[47]|6)"
COUNTRIES = "^(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
SECRET_STARTS = "^(?:AKIA|ASIA|AIza|ghp_|gho_|github_pat_|glpat-|sk-|sk_live_|pk_live_|xox[abprs]-|eyJ)"
CONTEXT = {
    "email": r"(?i)(?:mail|contact|write|address|reach)\W*(?:\w+\W+)?$",
    "ip": r"(?i)(?:\bip|host|server|address|from|login)\W*(?:\w+\W+)?$",
    "card": r"(?i)(?:card|visa|credit|payment|paid|account)\W*(?:\w+\W+)?$",
    "phone": r"(?i)(?:tel|phone|call|fax|mobile|cell|contact|whatsapp)\W*(?:\w+\W+)?$",
    "secret": r"(?i)(?:token|secret|passw(?:or)?d|api.?key|access.?key|private.?key|credential|bearer|auth\w*)[\"']?\s*(?:[:=]|is)?\s*[\"'`]?$",
}
#: Each labeler looks at evidence of its own: the form of the match, its check digits and ranges, lists, the words before it, and the characters about it.
LABELERS = ("shape", "valid", "gazetteer", "context", "edge")
LEFT_CHARS = 24
ROUNDS = 50
THRESHOLD = 0.5
#: Counts that a labeler starts with, by truth and vote: it is taken to be better than chance until the corpus tells.
START = {1: {-1: 0.5, 0: 1.0, 1: 2.0}, 0: {-1: 2.0, 0: 1.0, 1: 0.5}}


def prefix_sums(values: Column, width: int = 128) -> Column:
    """Exclusive prefix sums of an int array, by sums of blocks so that long arrays stay cheap."""
    add = lambda a, x: a + x
    n = F.size(values)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int")), lambda b: F.aggregate(F.slice(values, b * width + 1, F.lit(width)), F.lit(0), add))
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.aggregate(F.slice(blocks, F.lit(1), F.floor(i / width).cast("int")), F.lit(0), add)
        + F.aggregate(F.slice(values, F.floor(i / width).cast("int") * width + 1, i % width), F.lit(0), add),
    )


SPAN = "array<struct<start:int,stop:int,kind:int,match:string,left:string,right:string>>"


def with_matches(df: DataFrame, name: str, text: Column, pattern: str, needs: str, kind: int) -> DataFrame:
    """Adds array ``name`` of all matches with their code point positions and surroundings."""
    has = text.rlike(needs)
    df = df.withColumn("_found", F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    some = F.size("_found") > 0
    df = df.withColumn("_parts", F.when(some, F.split(text, pattern, -1)))
    steps = F.transform("_found", lambda m, i: F.length(m) + F.length(F.get("_parts", i)))
    df = df.withColumn("_before", F.when(some, prefix_sums(steps)))
    spans = F.transform(
        "_found",
        lambda m, i: F.struct(
            (F.get("_before", i) + F.length(F.get("_parts", i))).alias("start"),
            (F.get("_before", i) + F.length(F.get("_parts", i)) + F.length(m)).alias("stop"),
            F.lit(kind).alias("kind"),
            m.alias("match"),
            F.right(F.get("_parts", i), F.lit(LEFT_CHARS)).alias("left"),
            F.substring(F.get("_parts", i + 1), 1, 2).alias("right"),
        ),
    )
    return df.withColumn(name, F.when(some, spans).otherwise(F.array().cast(SPAN))).drop("_found", "_parts", "_before")


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string of at most 19 passes the Luhn check."""
    n = F.length(digits)

    def points(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + points(i)) % 10 == 0


def passes(span: Column) -> Column:
    """Whether a match of a base pattern passes its kind's conditions; looser forms are held to the same."""
    digits = digits_of(span["match"])
    part = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
    octets = F.filter(F.split(span["match"], "[^0-9]+"), lambda x: x != "")
    small = F.forall(octets, lambda x: (F.length(part(x)) <= 3) & (part(x).try_cast("int") <= 255)) & (F.size(octets) == 4)
    card = F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))
    return (
        F.when(span["kind"] == 0, F.lit(True))
        .when(span["kind"] == 1, span["match"].contains(":") | small)
        .when(span["kind"] == 2, card)
        .when(span["kind"] == 3, F.length(digits).between(9, 15))
        .otherwise(F.length(span["match"]) - F.length(F.regexp_replace(span["match"], "[0-9]", "")) >= 4)
    )


def sign(yes: Column, no: Column) -> Column:
    """A labeler's vote: 1, -1 or, abstaining, 0."""
    return F.when(yes, 1).when(no, -1).otherwise(0)


def by_kind(span: Column, *values: Column) -> Column:
    """The value for the span's kind, in the order of ``KINDS``."""
    found = values[-1]
    for k in range(len(values) - 2, -1, -1):
        found = F.when(span["kind"] == k, values[k]).otherwise(found)
    return found


def votes(span: Column) -> dict[str, Column]:
    """Votes of the labelers on a candidate span."""
    digits, match = digits_of(span["match"]), span["match"]
    ending = F.lower(F.regexp_extract(match, "([A-Za-z0-9-]+)$", 1))
    first = F.regexp_extract(match, "^([0-9]+)", 1).try_cast("int")
    valid = passes(span)
    plus = match.startswith("+")
    american = match.rlike(r"^\(?[2-9][0-9]{2}\)?[\x20.-]{1,2}[2-9][0-9]{2}[\x20.-][0-9]{4}$")
    shape = by_kind(
        span,
        sign(match.rlike(r"^[A-Za-z0-9].*[A-Za-z]{2}$"), match.rlike(r"[0-9-]$")),
        sign(match.rlike(r"^(?!.*(?:^|\D)0[0-9])[^:]*$") | match.contains(":"), match.rlike(r"(?:^|\D)0[0-9]|[0-9]{4}")),
        sign(match.rlike(r"^(?:[0-9]{13,16}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[0-9]{3}([\x20-])[0-9]{6}\2[0-9]{5})$"), ~match.rlike(r"^(?:[0-9]+|[0-9]{4}(?:[\x20._/-]{1,2}[0-9]{4}){3})$")),
        sign(plus | match.rlike(r"^(?:\([0-9]{2,4}\)|00)"), match.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+$")),
        sign(match.rlike(r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$") | (match.rlike("[a-z]") & match.rlike("[A-Z]") & match.rlike("[0-9]")), match.rlike(r"/.*/|^[A-Za-z]+[_-][A-Za-z]+[_-]|^[=_+/-]")),
    )
    gazetteer = by_kind(
        span,
        sign(ending.isin(DOMAINS), ending.rlike("^[0-9]+$")),
        sign(first.between(1, 223) & ~first.isin(10, 127), first.isin(0, 127) | (first > 239)),
        sign(digits.rlike(CARD_STARTS), ~digits.rlike(CARD_STARTS)),
        sign((plus & digits.rlike(COUNTRIES)) | american | F.regexp_replace(match, "^00", "").rlike(COUNTRIES) & match.startswith("00"), plus & ~digits.rlike(COUNTRIES)),
        sign(match.rlike(SECRET_STARTS), F.lit(False)),
    )
    near = by_kind(span, *(span["left"].rlike(CONTEXT[kind]) for kind in KINDS))
    glued = span["left"].rlike("[A-Za-z0-9_=/#.-]$") & (span["kind"] != 4) | span["right"].rlike("^(?:[A-Za-z0-9_=/#]|[.-][0-9])")
    return {
        "shape": shape,
        "valid": sign(valid & (span["kind"] != 0), ~valid),
        "gazetteer": gazetteer,
        # A credential is nothing but random characters: without a word that says so there is evidence against it.
        "context": sign(near, (span["kind"] == 4) & ~near),
        "edge": sign(F.lit(False), glued),
    }


def traits(span: Column) -> dict[str, Column]:
    """Features of a span for the final classifier, each of a few small ints; those that kinds don't share are apart by kind."""
    own = votes(span)
    digits = F.length(digits_of(span["match"]))
    length = F.length(span["match"])
    return {
        "kind": span["kind"],
        **{name: span["kind"] * 3 + own[name] + 1 for name in LABELERS},
        "length": F.least(F.floor(length / 6), F.lit(6)).cast("int"),
        "digits": F.least(F.floor(digits / 4), F.lit(5)).cast("int"),
        "left": F.when(span["left"] == "", 0).when(span["left"].rlike(r"\s$"), 1).when(span["left"].rlike("[A-Za-z0-9]$"), 2).otherwise(3),
        "right": F.when(span["right"] == "", 0).when(span["right"].rlike(r"^\s"), 1).when(span["right"].rlike("^[A-Za-z0-9]"), 2).otherwise(3),
    }


@dataclass
class SpanModel:
    """Weights by trait and value, a bias, and the labelers' estimated reliabilities."""

    weights: dict[str, dict[int, float]] = field(default_factory=dict)
    bias: float = -10.0
    reliabilities: dict[str, dict] = field(default_factory=dict)

    def logit(self, span: Column) -> Column:
        total = F.lit(float(self.bias))
        for name, value in traits(span).items():
            for v, w in self.weights.get(name, {}).items():
                total = total + F.when(value == v, float(w)).otherwise(0.0)
        return total


def expectation_maximisation(patterns: list[tuple[int, tuple[int, ...], float]], rounds: int = ROUNDS) -> tuple[list[float], dict]:
    """Posterior of each ``(kind, votes, count)`` pattern, and P(vote | truth) of each labeler by kind.

    Labelers are taken as independent given the truth; each kind has a prior and reliabilities of its own.
    Truth is named by the start, where votes are taken at their word.
    """
    posterior = [1 / (1 + math.exp(-1.5 * sum(v))) for _, v, _ in patterns]
    kinds = sorted({kind for kind, _, _ in patterns})
    tables: dict = {}
    for _ in range(rounds):
        prior = {kind: [1.0, 1.0] for kind in kinds}
        tables = {(kind, j, y): dict(START[y]) for kind in kinds for j in range(len(LABELERS)) for y in (0, 1)}
        for (kind, v, n), p in zip(patterns, posterior):
            prior[kind][0] += n * (1 - p)
            prior[kind][1] += n * p
            for j, vote in enumerate(v):
                tables[kind, j, 0][vote] += n * (1 - p)
                tables[kind, j, 1][vote] += n * p
        logs = {key: {vote: math.log(c / sum(t.values())) for vote, c in t.items()} for key, t in tables.items()}
        posterior = []
        for kind, v, _ in patterns:
            bad, good = (math.log(x) for x in prior[kind])
            for j, vote in enumerate(v):
                bad += logs[kind, j, 0][vote]
                good += logs[kind, j, 1][vote]
            posterior.append(1 / (1 + math.exp(max(-50.0, min(50.0, bad - good)))))
    share = lambda t: {vote: round(c / sum(t.values()), 4) for vote, c in t.items()}
    return posterior, {KINDS[kind]: {name: {y: share(tables[kind, j, y]) for y in (0, 1)} for j, name in enumerate(LABELERS)} for kind in kinds}


def fit_classifier(rows: list[tuple[dict[str, int], float, float]], steps: int = 400, ridge: float = 1e-3) -> tuple[dict[str, dict[int, float]], float]:
    """Logistic regression on ``(traits, soft label, count)`` rows by Adagrad."""
    weights: dict[tuple[str, int], float] = {(k, v): 0.0 for traits_of, _, _ in rows for k, v in traits_of.items()}
    squares = dict.fromkeys(weights, 1e-8)
    bias = square = 0.0
    total = sum(n for _, _, n in rows) or 1.0
    for _ in range(steps):
        gradient = {k: -ridge * w for k, w in weights.items()}
        slope = 0.0
        for traits_of, y, n in rows:
            keys = list(traits_of.items())
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + sum(weights[k] for k in keys)))))
            error = n * (y - p) / total
            slope += error
            for k in keys:
                gradient[k] += error
        square += slope**2
        bias += 0.3 * slope / math.sqrt(square + 1e-8)
        for k, g in gradient.items():
            squares[k] += g**2
            weights[k] += 0.3 * g / math.sqrt(squares[k])
    nested: dict[str, dict[int, float]] = {}
    for (name, value), w in weights.items():
        nested.setdefault(name, {})[value] = round(w, 6)
    return nested, round(bias, 6)


def candidates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base, loose``: matches of the base patterns, passing or not, and of the looser ones."""
    df = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    text = F.col("_text")
    for kind, pattern in BASE.items():
        df = with_matches(df, f"_{kind}", text, pattern, NEEDS[kind], KINDS.index(kind))
    for kind, pattern in LOOSE.items():
        df = with_matches(df, f"_loose_{kind}", text, pattern, LOOSE_NEEDS[kind], KINDS.index(kind))
    return df.select("doc_id", F.concat(*(f"_{k}" for k in BASE)).alias("base"), F.concat(*(f"_loose_{k}" for k in LOOSE)).alias("loose"))


def train(found: DataFrame) -> SpanModel:
    """Fit labelers' reliabilities and the span classifier on the candidates of all documents.

    Only counts of patterns of votes and traits reach the driver; their number is bounded
    by the traits' values, whatever the corpus.
    """
    spans = found.select(F.explode(F.concat("base", "loose")).alias("span"))
    columns = [v.cast("int").alias(f"v_{k}") for k, v in votes(F.col("span")).items()] + [t.cast("int").alias(f"t_{k}") for k, t in traits(F.col("span")).items()]
    names = [f"v_{k}" for k in LABELERS] + [f"t_{k}" for k in traits(F.col("span"))]
    rows = spans.select(*columns).groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).collect()
    if not rows:
        return SpanModel()
    counts: dict[tuple[int, tuple[int, ...]], float] = {}
    for r in rows:
        key = (r["t_kind"], tuple(r[f"v_{k}"] for k in LABELERS))
        counts[key] = counts.get(key, 0.0) + r["n"]
    patterns = [(kind, v, n) for (kind, v), n in sorted(counts.items())]
    posterior, reliabilities = expectation_maximisation(patterns)
    soft = {(kind, v): p for (kind, v, _), p in zip(patterns, posterior)}
    labelled = [({k[2:]: r[k] for k in names if k.startswith("t_")}, soft[r["t_kind"], tuple(r[f"v_{k}"] for k in LABELERS)], float(r["n"])) for r in rows]
    weights, bias = fit_classifier(labelled)
    return SpanModel(weights, bias, reliabilities)


def find_personal_data(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: SpanModel | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, base, spans, credentials``: arrays of ``start, kind, stop`` by start, then kind.

    ``base`` has the matches of the four base patterns that pass their conditions, leftmost
    and not overlapping within a kind. ``spans`` adds looser candidates of these kinds that the span
    classifier accepts; ``credentials`` are what it accepts as such. Nothing added overlaps a base span or another added one:
    the leftmost stays, and a credential gives way to the other kinds. ``model`` defaults to
    :func:`train` on these documents. Positions are code points, the end exclusive.

    One map over the table, whose candidates are written to the checkpoint folder (a row a document, without its text), since training
    reads them before the result does; nothing but pattern counts is shuffled.
    Null and empty texts have no spans. Repeated rows and null ids are kept; an empty table
    gives an empty result; other columns are not read.
    """
    found = scratch(candidates(documents, id_col, text_col))
    model = train(found) if model is None else model
    brief = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"))
    base = F.array_sort(F.transform(F.filter("base", passes), brief))
    limit = math.log(threshold / (1 - threshold))

    def apart_from(column: str):
        return lambda s: ~F.exists(column, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))

    def leftmost(spans: Column) -> Column:
        """Spans in order, without those that overlap one kept before."""
        keep = lambda kept, s: F.when((F.size(kept) > 0) & (s["start"] < F.element_at(kept, -1)["stop"]), kept).otherwise(F.concat(kept, F.array(s)))
        return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<start:int,kind:int,stop:int>>"), keep)

    accepted = found.withColumn("base", base).withColumn("loose", F.transform(F.filter("loose", lambda s: model.logit(s) >= limit), brief))
    accepted = accepted.withColumn("loose", F.filter("loose", apart_from("base")))
    credential = KINDS.index("secret")
    spans = accepted.withColumn("added", leftmost(F.filter("loose", lambda s: s["kind"] != credential))).withColumn("spans", F.array_sort(F.concat("base", "added")))
    return spans.select("doc_id", "base", "spans", leftmost(F.filter(F.filter("loose", lambda s: s["kind"] == credential), apart_from("added"))).alias("credentials"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), s["kind"]), s["start"], s["stop"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """The base counts and hash, the text of all spans and their number, and that of credentials, of :func:`find_personal_data` rows."""
    def of_kind(k: int):
        return lambda s: s["kind"] == k

    counts = [F.size(F.filter("base", of_kind(k))).cast("bigint").alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return found.select("doc_id", *counts, F.size("spans").cast("bigint").alias("n_spans"), F.sha2(F.encode(spans_text(F.col("base")), "UTF-8"), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"), spans_text(F.col("credentials")).alias("credentials"))
