"""Find personal data by fixed patterns and by labelers that vote.

Four kinds have exact patterns and are always kept. Other strings that may be personal
(telephone numbers without a country, national numbers, secrets) are candidates: labelers
of three sorts vote on each, for, against or not at all. Regex labelers look at its shape,
gazetteer labelers at its beginning and parts, context labelers at the words before it.
Nobody marks the truth, so expectation-maximisation over the vote patterns of all candidates
estimates how reliable each labeler is and how likely each pattern is personal. A logistic
classifier is then trained on these soft labels, over votes and shape features, and decides.

Everything is DataFrame expressions, also the classifier; no Python runs on executors. The
driver only sees counts per vote pattern and feature class, whose number is bounded by the
labelers (at most ``CELLS``) and not by the data. All candidates count.

A match's place follows from the lengths of matches and of the gaps between them. Patterns
are written so that scanning stays linear in very long texts: runs are taken whole and
are only entered at their start, which gives the same matches as the plain pattern.

Defined cases: a null or empty text has no spans. Repeated rows and rows with a null identifier are
treated like any others. With no candidates at all the classifier accepts none. Extra
spans that overlap a fixed one are dropped. Spans are in order of their start, so there are no ties. Texts are read whole
whatever their length. Only the named columns are read; others may have any names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("local_phone", "national_id", "secret")

# As the plain patterns, but entered only where a run starts (or where the last match ended).
# Looking back comes after the first digit, so most places are passed over at once.
_EMAIL = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
)
_IP = r"[0-9](?:(?<=\G[0-9])|(?<![0-9][0-9]))[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_IP_PARTS = r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])$"

_CANDIDATES = {
    "local_phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "national_id": r"(?<![0-9-])[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![0-9-])",
    "secret": (
        r"(?<![A-Za-z0-9_])(?=[A-Za-z_]*+[0-9])(?=[0-9]*+[A-Za-z_])[A-Za-z0-9_]{20,}+"
    ),
}

# Shape labelers: what speaks for a kind, and what speaks against it.
_SHAPES = {
    "local_phone": (r"^\([0-9]{3}\) |^[0-9]{3}([.-])[0-9]{3}\1", r"^\(?[01]"),
    "national_id": (r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$", r"^(000|666|9)"),
    "secret": (r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[A-Z0-9]{20})$", r"^[0-9]+[a-z]+$"),
}
_MIXED = {
    "local_phone": (r"555|[2-9][0-9]{2}", r"([0-9])\1\1[ .-]\1\1\1"),
    "national_id": (r"[0-9]{4}$", r"0000$"),
    "secret": (r"(?:[0-9]+[A-Za-z_]+){3}", r"[aeiou][a-z]{9}"),
}

# Gazetteers of beginnings, and of words that come before such strings.
# Beginnings: area codes of large cities and toll-free numbers; area numbers by which national numbers were
# issued in populous states; what services put before their secrets.
_AREA_CODES = (
    "202", "206", "210", "212", "213", "214", "215", "216", "301", "303", "305", "310", "312", "313", "314",
    "317", "323", "347", "404", "407", "408", "410", "412", "415", "416", "469", "480", "502", "503", "504",
    "510", "512", "513", "514", "555", "602", "604", "612", "614", "615", "617", "619", "646", "650", "702",
    "703", "704", "713", "714", "718", "720", "773", "800", "801", "808", "816", "818", "832", "833", "844",
    "855", "866", "877", "888", "901", "904", "917", "919", "949", "954", "972",
)
_KNOWN = {
    "local_phone": (*_AREA_CODES, *(f"({code}" for code in _AREA_CODES)),
    "national_id": (
        "05", "06", "07", "08", "09", "10", "11", "12", "13", "16", "17", "18", "19", "20", "26", "27",
        "28", "32", "33", "34", "35", "36", "37", "38", "45", "46", "54", "55", "56", "57", "58", "59",
    ),
    "secret": (
        "AKIA", "ASIA", "AGPA", "AIDA", "AROA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat",
        "sk_", "pk_", "rk_", "whsec_", "xox", "eyJ", "AIza", "ya29", "npm_", "hf_", "dop_v1_", "shpat_",
        "shpss_", "sq0", "EAAC", "lin_api_", "pat_", "key_",
    ),
}
_KNOWN_NOT = {
    "local_phone": ("000", "(000", "999", "(999", "0", "(0"),
    "national_id": ("000", "666", "9"),
    "secret": (
        "version", "chapter", "section", "figure", "http", "www", "file", "page", "test", "example",
        "sample", "lorem", "index", "table", "image", "img_", "utf", "iso", "rfc",
    ),
}
_CUES = {
    "local_phone": ("call", "tel", "phone", "fax", "mobile", "cell", "whatsapp"),
    "national_id": ("ssn", "social security", "passport", "national", "identity", "tax"),
    "secret": ("token", "secret", "password", "passwd", "pwd", "api", "key", "auth", "bearer"),
}
_CUES_NOT = {
    "local_phone": ("isbn", "order", "invoice", "part no", "serial"),
    "national_id": ("isbn", "order", "invoice", "part no", "serial", "date"),
    "secret": ("commit", "checksum", "sha1", "sha256", "md5", "etag", "revision"),
}
CONTEXT = 24

# Classes of a candidate's length and of its share of digits, as features.
_LENGTHS = (12, 24, 40)
_SHARES = (0.4, 0.6, 0.8)
LABELERS = 6
CELLS = len(EXTRA_KINDS) * 3**LABELERS * (len(_LENGTHS) + 1) * (len(_SHARES) + 1)

# Expectation-maximisation ends when no belief moves by more.
TOLERANCE = 1e-6


@dataclass(frozen=True)
class Classifier:
    """Log-odds per kind: intercept, one weight per vote, and one per feature class."""

    weights: dict[str, tuple[float, ...]]

    def accepts(self, candidate: Column) -> Column:
        """Whether a candidate is personal; kinds never seen are not."""
        score = F.lit(-1.0)
        for kind, (start, *rest) in self.weights.items():
            terms = F.lit(start)
            for w, x in zip(rest, _inputs(candidate)):
                terms = terms + F.lit(w) * x
            score = F.when(candidate["kind"] == kind, terms).otherwise(score)
        return score >= 0


def base_spans(text: Column) -> list[Column]:
    """For each fixed kind the array of its ``(kind, start, end)``, in order."""
    digits = lambda m: F.length(F.regexp_replace(m["value"], "[^0-9]", ""))
    checks = {
        "email": lambda m: F.lit(True),
        "ip": lambda m: F.forall(F.split(m["value"], r"\."), lambda p: p.rlike(_IP_PARTS)),
        "card": lambda m: _luhn(F.regexp_replace(m["value"], "[^0-9]", "")),
        "phone": lambda m: digits(m).between(9, 15),
    }
    digit = text.rlike("[0-9]")
    seen = {"email": text.contains("@"), "ip": digit, "card": digit, "phone": text.contains("+")}
    patterns = dict(zip(BASE_KINDS, (_EMAIL, _IP, _CARD, _PHONE)))

    def spans(kind: str) -> Column:
        found = F.filter(_located(text, patterns[kind], seen[kind]), checks[kind])
        return F.transform(
            found,
            lambda m: F.struct(
                F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")
            ),
        )

    return [spans(kind) for kind in BASE_KINDS]


def candidates(text: Column) -> Column:
    """Strings that may be personal, each with its votes and features. All have a digit."""
    digit = text.rlike("[0-9]")

    def voted(kind: str, pattern: str) -> Column:
        return F.transform(_located(text, pattern, digit), lambda m: _voted(text, m, kind))

    return F.concat(*[voted(kind, pattern) for kind, pattern in _CANDIDATES.items()])


def fit_classifier(docs: DataFrame, text: str = "text", tolerance: float = TOLERANCE) -> Classifier:
    """One pass over all documents to count patterns, then EM and training on the counts."""
    cells = (
        docs.select(F.inline(candidates(F.coalesce(F.col(text), F.lit("")))))
        .groupBy("kind", "votes", "long", "digits")
        .count()
        .collect()
    )
    by_kind = defaultdict(list)
    for cell in sorted(cells, key=lambda c: (c["kind"], c["votes"], c["long"], c["digits"])):
        by_kind[cell["kind"]].append(cell)
    return Classifier(
        {kind: _train(docs, rows, _posteriors(rows, tolerance)) for kind, rows in by_kind.items()}
    )


def find_spans(
    docs: DataFrame, classifier: Classifier, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, base, extra)``: per document both arrays of ``(kind, start, end)``."""
    return _with_spans(
        docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")), classifier
    ).select("doc_id", F.flatten(F.array(*BASE_KINDS)).alias("base"), *BASE_KINDS, "extra")


def redact(docs: DataFrame, classifier: Classifier, text: str = "text") -> DataFrame:
    """Every span replaced by its kind in angle brackets; all columns stay as they are."""
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(f"`{text}`").alias("text"),
    )
    found = _with_spans(whole, classifier)
    spans = F.array_sort(
        F.transform(
            F.concat(*BASE_KINDS, "extra"),
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
        )
    )
    cut = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.concat(
                    acc["out"],
                    F.substring(
                        F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))
                    ),
                    F.lit("<"), F.upper(s["kind"]), F.lit(">"),
                ).alias("out"),
            )
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
    some = F.size(F.concat(*BASE_KINDS, "extra")) > 0
    done = found.withColumn("redacted", F.when(some, cut).otherwise(F.col("row")[text]))
    return done.select(
        *[
            F.col("redacted").alias(c) if c == text else F.col("row")[c].alias(c)
            for c in docs.columns
        ]
    )


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def _with_spans(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """``docs`` with an array for each fixed kind and ``extra``; a null text becomes empty."""
    text = F.col("text")
    found = docs.withColumn("text", F.coalesce(text.cast("string"), F.lit("")))
    found = found.withColumns(dict(zip(BASE_KINDS, base_spans(text))))
    found = found.withColumn("maybe", candidates(text))
    base = F.concat(*BASE_KINDS)
    accepted = F.filter(
        "maybe",
        lambda c: classifier.accepts(c)
        & ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])),
    )
    extra = F.transform(
        accepted,
        lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")),
    )
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return found.withColumn("extra", F.when(F.size("maybe") > 0, extra).otherwise(none)).drop(
        "maybe"
    )


def _located(text: Column, pattern: str, possible: Column) -> Column:
    """``(start, end, value)`` of every match, from the lengths of matches and gaps.

    ``possible`` is a quick test that texts with a match pass. The conditions are nested
    rather than joined by ``&``, because only so is the pattern not run where it fails.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.zip_with(
        matches, gaps, lambda value, gap: F.struct(value.alias("value"), gap.alias("gap"))
    )
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    placed = F.aggregate(
        F.filter(pairs, lambda p: p["value"].isNotNull()),
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + p["gap"] + F.length(p["value"])).alias("at"),
            F.concat(
                acc["out"],
                F.array(
                    F.struct(
                        (acc["at"] + p["gap"]).alias("start"),
                        (acc["at"] + p["gap"] + F.length(p["value"])).alias("end"),
                        p["value"].alias("value"),
                    )
                ),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(possible, F.when(F.size(matches) > 0, placed).otherwise(empty)).otherwise(empty)


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc + _luhn_digit(F.ascii(F.substring(digits, n - i + 1, F.lit(1))) - 48, i),
    )
    return n.between(13, 19) & (total % 10 == 0)


def _luhn_digit(d: Column, place: Column) -> Column:
    return F.when(place % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)


def _voted(text: Column, m: Column, kind: str) -> Column:
    value = m["value"]
    before = F.lower(
        F.substring(text, F.greatest(m["start"] - CONTEXT, F.lit(0)) + 1, F.least(m["start"], F.lit(CONTEXT)))
    )
    says = [
        _vote(value.rlike(_SHAPES[kind][0]), value.rlike(_SHAPES[kind][1])),
        _vote(value.rlike(_MIXED[kind][0]), value.rlike(_MIXED[kind][1])),
        _vote(_starts(value, _KNOWN[kind]), _starts(value, _KNOWN_NOT[kind])),
        _vote(before.rlike(_any(_CUES[kind])), before.rlike(_any(_CUES_NOT[kind]))),
        _vote(before.rlike(r"[=:] *[\"'`(]*$"), before.rlike(r"[A-Za-z0-9/._-]$")),
        _vote(before.rlike(_any(_CUES[kind]) + r"[^A-Za-z]{0,8}$"), before.rlike(r"[0-9][ ,;]*$")),
    ]
    length = F.length(value)
    share = F.length(F.regexp_replace(value, "[^0-9]", "")) / length
    return F.struct(
        F.lit(kind).alias("kind"),
        m["start"].alias("start"),
        m["end"].alias("end"),
        F.array(*says).alias("votes"),
        sum(((length > x).cast("int") for x in _LENGTHS), F.lit(0)).alias("long"),
        sum(((share > x).cast("int") for x in _SHARES), F.lit(0)).alias("digits"),
    )


def _vote(pro: Column, contra: Column) -> Column:
    return F.when(pro, 1).when(contra, -1).otherwise(0)


def _starts(value: Column, beginnings: Sequence[str]) -> Column:
    return value.rlike("^" + _any(beginnings)) if beginnings else F.lit(False)


def _any(words: Sequence[str]) -> str:
    quoted = (w.replace("(", r"\(") for w in words)
    return f"(?:{'|'.join(quoted)})"


def _inputs(candidate) -> list:
    votes = [candidate["votes"][i] for i in range(LABELERS)]
    return [*votes, candidate["long"], candidate["digits"]]


def _posteriors(cells, tolerance: float) -> dict[tuple[int, ...], float]:
    """Probability that a vote pattern is personal, by expectation-maximisation.

    Labelers are independent given the truth. The start leans to the majority, and one
    counted vote of each sort keeps probabilities off zero.
    """
    counts: dict[tuple[int, ...], int] = defaultdict(int)
    for cell in cells:
        counts[tuple(cell["votes"])] += cell["count"]
    total = sum(counts.values())
    belief = {v: 1 / (1 + math.exp(-sum(v))) for v in counts}
    moved = 1.0
    while moved > tolerance:  # the likelihood only rises, so steps shrink
        moved = 0.0
        share = (sum(n * belief[v] for v, n in counts.items()) + 1) / (total + 2)
        says = [
            [_reliability(counts, belief, i, truth) for i in range(LABELERS)] for truth in (0, 1)
        ]
        for v in counts:
            odds = math.log(share / (1 - share)) + sum(
                math.log(says[1][i][x] / says[0][i][x]) for i, x in enumerate(v)
            )
            new = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
            belief[v], moved = new, max(moved, abs(new - belief[v]))
    return belief


def _reliability(counts, belief, labeler: int, truth: int) -> dict[int, float]:
    """How often a labeler votes each way on personal (or other) strings.

    The added votes expect it to be right rather than wrong, which tells the two
    classes apart when nearly all candidates are of one.
    """
    right = 1 if truth else -1
    seen = {x: 2.0 if x == right else 1.0 for x in (-1, 0, 1)}
    for v, n in counts.items():
        seen[v[labeler]] += n * (belief[v] if truth else 1 - belief[v])
    whole = sum(seen.values())
    return {x: n / whole for x, n in seen.items()}


def _train(docs: DataFrame, cells, belief) -> tuple[float, ...]:
    """Logistic regression on the soft labels: a cell counts for both classes by belief."""
    names = [f"x{i}" for i in range(LABELERS + 2)]
    rows = []
    for cell in cells:
        p = belief[tuple(cell["votes"])]
        x = [float(v) for v in _inputs(cell)]
        rows += [(1.0, cell["count"] * p, *x), (0.0, cell["count"] * (1 - p), *x)]
    frame = docs.sparkSession.createDataFrame(rows, ["label", "weight", *names])
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(frame)
    model = LogisticRegression(
        weightCol="weight", regParam=0.001, maxIter=50, standardization=False
    ).fit(vectors)
    return (float(model.intercept), *map(float, model.coefficients))
