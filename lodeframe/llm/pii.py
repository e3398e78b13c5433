"""Personal data by weak supervision.

Patterns propose candidate spans: those of the four base kinds, and looser ones (local phone numbers, spelled-out
addresses, dotted card numbers, long-form IP addresses). Labelers then vote for (1), against (-1) or not at all (0) on
each candidate: the format's own check, a gazetteer (top-level domains, issuers, calling codes, address ranges), the
words before it, and its neighbours. How often each combination of votes occurs in the whole corpus, a table of at most
4 * 3**4 rows, is all that expectation-maximisation needs to estimate each labeler's reliability for each kind, and
a logistic regression on the votes and on features of the span that no labeler looks at, fitted to the posterior
probabilities, is the classifier that decides on the looser candidates. Spans of the base patterns that pass their checks are always kept.

Every step on texts is a Spark expression. No pattern repeats a group without bound, so that texts of any length and
content match in constant stack.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, let, quoted, written

#: Kinds in the order of the output.
KINDS = ("email", "ip", "card", "phone")
VOTES = ("format", "gazetteer", "context", "neighbours")
#: What the classifier sees of a span besides, each from 0 to 3.
FEATURES = ("size", "digits", "joints", "company")

# Patterns of the base kinds. They are applied to a text in which JOINT stands for each single space or
# hyphen between digits (card), or each dot between the labels of a domain (email). Starting only where a run starts, or
# the last match ended, finds the same matches in linear time.
JOINT = "\ue000"
JOINTS = {"card": "(?<=[0-9])[ -](?=[0-9])", "email": r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])"}
BASE = {
    "email": rf"(?:\G|(?<![A-Za-z0-9._%+{JOINT}-]))[A-Za-z0-9._%+{JOINT}-]++@[A-Za-z0-9-]++{JOINT}[A-Za-z0-9{JOINT}-]++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": rf"[0-9][0-9{JOINT}]+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Looser patterns.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]{2,24}){1,3}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9.])[0-9]{4}\.[0-9]{4}\.[0-9]{4}\.[0-9]{2,7}(?![0-9.])",
    "phone": r"(?<![0-9+().-])\(?[0-9]{3,5}\)?[ .-][0-9]{3,4}[ .-][0-9]{4}(?![0-9-])",
}
# Words before a span that speak for its kind, or against any.
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|address|reach)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|client|gateway|dns)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment|account)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|contact|whatsapp|sms)\b",
}
AGAINST = r"(?i)\b(?:version|release|isbn|issn|order|invoice|sku|serial|build|chapter|section|page|token|id)\b"
# Gazetteers.
DOMAINS = (
    "com org net edu gov mil int info biz io co dev app ai me tv uk us ca au nz ie de at ch fr be nl lu es pt it gr dk "
    "se no fi is pl cz sk hu ro bg hr si rs ua ru tr il sa ae eg za ng ke in pk bd lk cn hk tw jp kr sg my th vn id ph "
    "mx br ar cl pe example test"
).split()
CALLING_CODES = r"^\+?(?:1|7|2[0-9]|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1-6]|9[0-8])"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[4-9]|6[0-9])"

SPAN = "array<struct<start:bigint,stop:bigint,found:string,before:string,after:string>>"
#: Code points before a span that the labelers see.
SEEN = 40


def matched(text: Column, pattern: str, wanted: Column) -> Column:
    """All matches of a pattern in a text where ``wanted``, in order: SPAN, positions in code points, stop exclusive;
    before holds the text's SEEN code points before the match, other matches among them.

    Each match's position is the sum of the lengths before it, which are added up by blocks."""
    both = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between")
    )
    parts = lambda s: F.transform(
        s["found"],
        lambda m, i: F.struct(F.get(s["between"], i).alias("b"), m.alias("m"), F.left(F.get(s["between"], i + 1), F.lit(1)).alias("a")),
    )
    block = lambda own, earlier: F.struct(
        own.alias("own"),
        F.aggregate(own, F.lit(0).cast("long"), lambda n, p: n + F.length(p["b"]) + F.length(p["m"])).alias("length"),
        F.right(F.array_join(F.transform(earlier, lambda p: F.concat(p["b"], p["m"])), ""), F.lit(SEEN)).alias("tail"),
    )

    def step(state: Column, part: Column) -> Column:
        begin = state["at"] + F.length(part["b"])
        stop = begin + F.length(part["m"])
        before = F.right(F.concat(state["tail"], part["b"]), F.lit(SEEN))
        span = F.struct(
            begin.alias("start"), stop.alias("stop"), part["m"].alias("found"), before.alias("before"), part["a"].alias("after")
        )
        return F.struct(
            stop.alias("at"),
            F.right(F.concat(before, part["m"]), F.lit(SEEN)).alias("tail"),
            F.concat(state["spans"], F.array(span)).alias("spans"),
        )

    none = F.array().cast(SPAN)
    start = F.array(F.lit(0).cast("long"))
    sums = lambda parts: F.aggregate(parts, start, lambda at, x: F.concat(at, F.array(F.element_at(at, -1) + x["length"])))
    spans = lambda s: F.flatten(
        F.transform(
            s["blocks"],
            lambda x, i: F.aggregate(
                x["own"],
                F.struct(F.get(s["sums"], i).alias("at"), x["tail"].alias("tail"), none.alias("spans")),
                step,
                lambda state: state["spans"],
            ),
        )
    )
    found = let(
        let(let(both, parts), lambda p: blocks(p, block, SEEN)),
        lambda x: let(F.struct(x.alias("blocks"), sums(x).alias("sums")), spans),
    )
    return F.when(wanted, found).otherwise(none)


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def checked(kind: str, found: Column) -> Column:
    """Whether a match passes the check of its format."""
    digits = _digits(found)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return found.rlike(rf"^{part}\.{part}\.{part}\.{part}$") | found.contains(":")
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(10, 15)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(kind: str, base: bool, span: Column) -> list[Column]:
    """The labelers' votes on a candidate, in the order of VOTES."""
    found, digits = span["found"], _digits(span["found"])
    if kind == "email":
        listed = F.lower(F.regexp_extract(found, r"([A-Za-z0-9-]+)\W*$", 1)).isin(DOMAINS)
        known = _vote(listed, ~listed)
    elif kind == "ip":
        first = F.coalesce(F.regexp_extract(found, r"^0*([0-9]{1,3})\.", 1).try_cast("int"), F.lit(0))
        known = _vote(first.between(1, 223), ~first.between(1, 223)) if base else F.lit(0)
    elif kind == "card":
        known = _vote(digits.rlike(ISSUERS), ~digits.rlike(ISSUERS))
    else:
        known = _vote(found.startswith("+") & found.rlike(CALLING_CODES), digits.rlike(r"^([0-9])\1+$"))
    glued = (F.right(span["before"], F.lit(1)).rlike("[A-Za-z0-9_=/#-]")) | span["after"].rlike("[A-Za-z0-9_=/#-]")
    passes = checked(kind, found)
    return [
        _vote(passes, ~passes),
        known,
        _vote(span["before"].rlike(CONTEXT[kind]), span["before"].rlike(AGAINST)),
        _vote(~glued, glued),
    ]


def features(span: Column) -> list[Column]:
    """What the classifier sees of a span, in the order of FEATURES: its length, how much of it is digits, how many
    characters join its parts, and how many digits stand shortly before it."""
    found, size, digits = span["found"], F.length(span["found"]), F.length(_digits(span["found"]))
    joints = size - F.length(F.translate(found, " .-()@:" + JOINT, ""))
    return [
        F.least(F.floor(size / 8), F.lit(3)),
        F.floor(3 * digits / size),
        F.least(joints, F.lit(3)),
        F.least(F.floor(F.length(_digits(span["before"])) / 4), F.lit(3)),
    ]


def _wanted(text: Column, kind: str, base: bool) -> Column:
    """A cheap condition without which a pattern can't match."""
    if kind == "email":
        return text.contains("@") if base else text.rlike(r"[\[(]at[\])]")
    if kind == "phone" and base:
        return text.contains("+")
    return text.rlike(":[0-9A-Fa-f]{1,4}:" if kind == "ip" and not base else "[0-9]")


def _candidates(text: Column, kind: str, base: bool) -> Column:
    searched = text
    if base and kind in JOINTS:
        # JOINT in the text itself gives way, so that it marks joints only; lengths stay
        searched = F.regexp_replace(F.translate(text, JOINT, "?"), JOINTS[kind], JOINT)
    number = KINDS.index(kind)
    # of the numbers, only those of a phone's or card's length at least; what is shorter is no candidate
    least = {"card": 12, "phone": 7}.get(kind, 0)

    def voted(span: Column) -> Column:
        if base and kind == "email":
            plain = F.translate(span["found"], JOINT, ".")
            span = F.struct(span["start"], span["stop"], plain.alias("found"), span["before"], span["after"])
        return F.struct(
            span["start"].alias("start"),
            F.lit(number).alias("kind"),
            span["stop"].alias("stop"),
            (F.lit(base) & checked(kind, span["found"])).alias("base"),
            *[v.cast("int").alias(n) for v, n in zip(votes(kind, base, span), VOTES)],
            *[x.cast("int").alias(n) for x, n in zip(features(span), FEATURES)],
        )

    found = matched(searched, (BASE if base else LOOSE)[kind], _wanted(text, kind, base))
    long = F.filter(found, lambda x: F.length(_digits(x["found"])) >= least) if least else found
    return F.transform(long, voted)


def candidates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """A stored table (doc_id, c): each document's candidates with their votes. Null texts are empty."""
    body = F.coalesce(quoted(text), F.lit(""))
    found = F.concat(*[_candidates(body, kind, base) for base in (True, False) for kind in KINDS])
    return written(docs.select(quoted(id_column).alias("doc_id"), found.alias("c")), "pii-candidates")


def reliabilities(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 50) -> dict:
    """Expectation-maximisation over (kind, votes, count): for each kind (prior, tables, posteriors), where tables has for
    each labeler and truth the probabilities of its votes, and posteriors the probability that a candidate with such
    votes is personal data. Starts from the majority."""
    out = {}
    for kind in sorted({k for k, _, _ in patterns}):
        own = [(v, n) for k, v, n in patterns if k == kind]
        total = sum(n for _, n in own)
        belief = {v: 0.5 + 0.4 * max(-1, min(1, sum(v) / 2)) for v, _ in own}
        prior, tables = 0.5, []
        for _ in range(rounds):
            yes = sum(n * belief[v] for v, n in own)
            prior = (yes + 1) / (total + 2)
            tables = []
            for i in range(len(VOTES)):
                table = {}
                for truth in (0, 1):
                    weight = yes if truth else total - yes
                    for vote in (-1, 0, 1):
                        held = sum(n * (belief[v] if truth else 1 - belief[v]) for v, n in own if v[i] == vote)
                        lean = 0.5 if vote == 0 else 1.0 if (vote > 0) == bool(truth) else 0.25  # labelers beat chance
                        table[truth, vote] = (held + lean) / (weight + 1.75)
                tables.append(table)
            for v, _ in own:
                odds = math.log(prior / (1 - prior)) + sum(
                    math.log(t[1, x] / t[0, x]) for t, x in zip(tables, v)
                )
                belief[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        out[kind] = prior, tables, belief
    return out


def span_classifier(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 400) -> list[list[float]]:
    """For each kind the constant and the weights of a logistic regression, from (kind, seen, count), where seen are
    the votes and then the features. It is fitted to the posteriors that reliabilities() gives the votes, by gradient
    descent. A kind without candidates rejects."""
    width = max((len(seen) for _, seen, _ in patterns), default=len(VOTES))
    voted: Counter = Counter()
    for kind, seen, n in patterns:
        voted[kind, seen[: len(VOTES)]] += n
    known = reliabilities([(k, v, n) for (k, v), n in sorted(voted.items())])
    out = []
    for kind in range(len(KINDS)):
        own = [(seen, n) for k, seen, n in patterns if k == kind]
        if not own:
            out.append([-1.0] + [0.0] * width)
            continue
        x = np.array([(1, *seen) for seen, _ in own], dtype=float)
        share = np.array([n for _, n in own], dtype=float)
        share /= share.sum()
        belief = np.array([known[kind][2][seen[: len(VOTES)]] for seen, _ in own])
        x[:, 1 + len(VOTES) :] /= 3
        beta = np.zeros(1 + width)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            beta -= x.T @ (share * (p - belief)) + 1e-3 * beta
        beta[1 + len(VOTES) :] /= 3
        out.append(beta.tolist())
    return out


def personal_data(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and spans for each row of ``docs``: arrays of (start, kind, stop), by start, then kind as in KINDS.

    base are the checked matches of the base patterns; spans has these and the candidates that the classifier accepts
    and that overlap none of them. Null and empty texts have none, and neither does an empty table have rows. Repeated
    rows and ids stand for themselves. Texts are searched whole, in time that grows with their length; the spans of a
    text have to fit into one row. Other columns are not read, whatever their names.
    """
    found = candidates(docs, id_column, text)
    each = found.select(F.explode("c").alias("x")).select("x.*")
    names = (*VOTES, *FEATURES)
    counted = each.groupBy("kind", *names).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 4 * 3**4 * 4**4 rows
    patterns = sorted((r["kind"], tuple(r[v] for v in names), r["n"]) for r in counted)
    weights = span_classifier(patterns)
    slim = lambda x: F.struct(x["start"], x["kind"], x["stop"])

    weights = [w + [0.0] * (1 + len(names) - len(w)) for w in weights]  # an empty table has no features

    def accepted(x: Column) -> Column:
        of = lambda i: F.get(F.array(*[F.lit(float(w[i])) for w in weights]), x["kind"])
        score = of(0)
        for i, name in enumerate(names):
            score = score + of(i + 1) * x[name]
        return score > 0

    block = lambda own, _: F.struct(
        own.alias("own"), F.get(own, 0)["start"].alias("start"), F.array_max(F.transform(own, lambda b: b["stop"])).alias("stop")
    )
    meets = lambda a, b: (a["start"] < b["stop"]) & (b["start"] < a["stop"])

    def with_more(s: Column) -> Column:
        taken = lambda x: F.exists(s["blocks"], lambda k: meets(k, x) & F.exists(k["own"], lambda b: meets(b, x)))
        more = F.filter(s["c"], lambda x: ~x["base"] & (x["format"] >= 0) & accepted(x))
        free = F.filter(more, lambda x: ~F.coalesce(taken(x), F.lit(False)))
        return F.struct(s["base"].alias("base"), F.array_sort(F.concat(s["base"], F.transform(free, slim))).alias("spans"))

    base = F.array_sort(F.transform(F.filter("c", lambda x: x["base"]), slim))
    both = let(
        base,
        lambda b: let(F.struct(F.col("c").alias("c"), b.alias("base"), blocks(b, block).alias("blocks")), with_more),
    )
    return found.select("doc_id", both.alias("x")).select("doc_id", "x.base", "x.spans")


def spans_text(spans: Column) -> Column:
    """kind:start:stop, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def op6_pii(spark, sf_dir: str) -> DataFrame:
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )
