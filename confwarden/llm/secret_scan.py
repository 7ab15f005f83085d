"""Secret scans: trigram queries over an inverted index choose what each rule verifies."""

from functools import reduce
from re import _constants as op
from re import _parser
from typing import NamedTuple

from pyspark.sql import functions as F

from confwarden.session import land, work_folder


class Rule(NamedTuple):
    """``value`` is a group of which at least ``least`` characters are needed, 0 the match."""

    kind: str
    pattern: str
    value: int = 0
    least: int = 0


# The base rules, then rules for credentials of well-known forms.
BASE_RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    # A run from AKIA or of hexadecimal digits that is too short holds no longer one.
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE_RULES + MORE_RULES

_MOST_STRINGS = 64


# Boolean trigram queries ----------------------------------------------------------
def _and(parts):
    parts = [p for p in parts if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", *dict.fromkeys(parts))


def _or(parts):
    parts = list(dict.fromkeys(parts))
    return None if None in parts or not parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _grams(strings):
    """Any of the strings, each by all its trigrams; no condition if one is too short.

    A string that demands all that another does, and more, adds nothing.
    """
    each = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    least = [a for a in each if not any(b < a for b in each)]
    return _or([_and(sorted(a)) for a in sorted(least, key=sorted)])


def _strings(kind, value):
    """All strings a node can match, in lower case, or None if there are many."""
    if kind == op.LITERAL:
        return {chr(value).lower()}
    if kind == op.IN:
        if all(k == op.LITERAL for k, _ in value):
            return {chr(v).lower() for _, v in value}
    elif kind == op.SUBPATTERN:
        return _sequence_strings(value[-1])
    elif kind == op.BRANCH:
        each = [_sequence_strings(b) for b in value[1]]
        return set().union(*each) if None not in each else None
    elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[1] == 1:
        inner = _sequence_strings(value[2])
        return inner | {""} if inner is not None and value[0] == 0 else inner
    return None


def _sequence_strings(nodes):
    out = {""}
    for kind, value in nodes:
        more = _strings(kind, value)
        if more is None or len(out) * len(more) > _MOST_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def _query(nodes):
    """What a sequence demands: of its runs of few strings, and of the nodes in between."""
    clauses, run = [], {""}
    for kind, value in nodes:
        more = _strings(kind, value)
        if more is not None and len(run) * len(more) <= _MOST_STRINGS:
            run = {a + b for a in run for b in more}
            continue
        clauses.append(_grams(run))
        run = more or {""}
        if more is None:
            if kind == op.SUBPATTERN:
                clauses.append(_query(value[-1]))
            elif kind == op.BRANCH:
                clauses.append(_or([_query(b) for b in value[1]]))
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] > 0:
                clauses.append(_query(value[2]))
    return _and([*clauses, _grams(run)])


def trigram_query(pattern):
    """The trigrams of lower-cased text without which a pattern cannot match.

    A trigram, ``("and", ...)`` or ``("or", ...)``; None if the pattern has no such condition.
    """
    return _query(_parser.parse(pattern))


def query_grams(query):
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(query_grams, query[1:]))


def _holds(query, present):
    """Whether the postings of one document satisfy a query."""
    if isinstance(query, str):
        return F.array_contains(present, query)
    joined = [_holds(q, present) for q in query[1:]]
    return reduce(lambda a, b: a & b if query[0] == "and" else a | b, joined)


# Index, candidates, verification -----------------------------------------------------
def trigram_index(docs, grams):
    """Postings ``gram, doc_id`` of the given trigrams in the lower-cased texts."""
    docs = docs.select("doc_id", F.lower("text").alias("low"))
    present = [F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in sorted(grams)]
    return docs.select("doc_id", F.explode(F.array_compact(F.array(*present))).alias("gram")).select(
        "gram", "doc_id"
    )


def candidates(index, rules=RULES):
    """``doc_id, rules``: the kinds whose query the postings of a document satisfy."""
    queries = [(r.kind, trigram_query(r.pattern)) for r in rules]
    posted = index.groupBy("doc_id").agg(F.collect_set("gram").alias("present"))
    chosen = [F.when(_holds(q, F.col("present")), F.lit(k)) for k, q in queries if q is not None]
    return posted.select("doc_id", F.array_compact(F.array(*chosen)).alias("rules")).where(F.size("rules") > 0)


def _let(value, body):
    """``body`` of a column that is computed once for each row, however often it is used.

    Spark may write a column's expression wherever it is used, inside a lambda once for each element.
    """
    return F.get(F.transform(F.array(value), body), 0)


def running(items, zero, step, block=64):
    """What ``step`` makes of all items before each, one for each item, from ``zero``.

    ``step(acc, item)`` adds an item; it has to be associative and to take a sum as an item by
    ``step(acc, sum)``, so items are numbers.  Done in blocks: appending one by one to an array,
    or adding up anew for each item, would take the square of their number.
    """

    def in_blocks(parts):
        def total(acc, part):
            return F.array_append(acc, step(F.element_at(acc, -1), F.aggregate(part, zero, step)))

        heads = F.aggregate(parts, F.array(zero), total)
        each = F.zip_with(
            parts, F.slice(heads, 1, F.size(parts)), lambda part, head: F.transform(
                part, lambda _, i: F.aggregate(F.slice(part, F.lit(1), i), head, step)
            )
        )
        return F.flatten(each)

    def cut(all_items):
        first = F.sequence(F.lit(0), F.floor((F.size(all_items) - 1) / block).cast("int"))
        return F.transform(first, lambda i: F.slice(all_items, i * block + 1, F.lit(block)))

    return _let(items, lambda x: F.when(F.size(x) > 0, _let(cut(x), in_blocks)).otherwise(F.array().cast("array<int>")))


STEPS = "array<struct<gap:int,size:int,value:int>>"
SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _steps(rule):
    """The matches of a rule in the column text: characters since the last one, of it, of its value."""
    pattern = F.lit(rule.pattern)

    def measured(found):
        between = F.slice(F.split("text", rule.pattern, -1), F.lit(1), F.size(found))
        steps = F.zip_with(
            between, found, lambda g, x: F.struct(F.length(g).alias("gap"), F.length(x).alias("size"), F.length(x).alias("value"))
        )
        if rule.value:
            values = F.regexp_extract_all("text", pattern, F.lit(rule.value))
            steps = F.zip_with(
                steps, values, lambda x, v: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), F.length(v).alias("value"))
            )
        return F.when(F.size(found) > 0, steps).otherwise(F.array().cast(STEPS))

    return _let(F.regexp_extract_all("text", pattern, F.lit(0)), measured)


def _spans(ruled):
    """The spans of the matches of one rule that have a value long enough."""
    steps = ruled["steps"]
    before = running(F.transform(steps, lambda x: x["gap"] + x["size"]), F.lit(0), lambda acc, x: acc + x)
    good = F.filter(
        F.zip_with(steps, before, lambda x, at: F.struct((at + x["gap"]).alias("start"), x["size"].alias("size"), x["value"].alias("value"))),
        lambda x: x["value"] >= ruled["least"],
    )
    return F.transform(
        good,
        lambda x: F.struct(
            x["start"].alias("start"),
            ruled["rank"].alias("rank"),
            ruled["kind"].alias("kind"),
            (x["start"] + x["size"]).alias("end"),
        ),
    )


def find_secrets(spark, docs, rules=RULES, carry=(), id_col="doc_id", text_col="text"):
    """``doc_id, secrets`` (and the columns ``carry``), one row per row of ``docs``.

    ``secrets`` are the spans of all rules, sorted by start, then by the order of the rules:
    ``start, rank, kind, end`` in code points, end exclusive.  Each rule gives leftmost,
    non-overlapping matches, of which those with too short a value are dropped.

    The trigrams that the rules' queries name are posted for every document; intersecting the
    postings leaves each rule its candidates, which its regular expression verifies.  Rules
    without mandatory trigrams verify every text.  Built-in functions only.  Null and empty
    texts have no secrets.  A null id has no postings, so all rules verify its text; rows of
    one id share their postings, which only adds candidates.
    """
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        *[F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)],
    )
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    grams = set().union(*map(query_grams, queries.values()))
    if grams:
        index = trigram_index(base.where("doc_id IS NOT NULL").select("doc_id", "text"), grams)
        chosen = land(candidates(index, rules), work_folder(spark, "candidates"))
        base = base.join(chosen, "doc_id", "left")
    else:
        base = base.withColumn("rules", F.lit(None).cast("array<string>"))
    each = []
    for rank, rule in enumerate(rules):
        steps = _steps(rule)
        if queries[rule.kind] is not None:
            may = F.col("doc_id").isNull() | F.coalesce(F.array_contains("rules", rule.kind), F.lit(False))
            steps = F.when(may, steps).otherwise(F.array().cast(STEPS))
        each.append(
            F.struct(F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), F.lit(rule.least).alias("least"), steps.alias("steps"))
        )
    matched = F.filter(F.array(*each), lambda x: F.size(x["steps"]) > 0)
    spans = F.array_sort(F.flatten(F.transform(matched, _spans))) if each else F.array()
    return base.select(
        "doc_id",
        spans.cast(SPANS).alias("secrets"),
        *[F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry)],
    )


def span_text(spans):
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redact(text, spans, mark="[SECRET]", block=1024):
    """``text`` with each span, or spans that overlap, replaced by ``mark``.

    Taken from blocks of the text: to find a place, Spark counts characters from the start.
    """

    def cut(first, last, blocks):
        """The characters ``first`` to ``last`` (exclusive)."""
        low = F.floor(first / block).cast("int")
        high = F.floor((last + block - 1) / block).cast("int")
        near = F.array_join(F.slice(blocks, low + 1, F.greatest(high - low, F.lit(0))), "")
        return F.substring(near, first - low * block + 1, last - first)

    def joined(blocks):
        before = running(F.transform(spans, lambda x: x["end"]), F.lit(0), lambda acc, x: F.greatest(acc, x))
        # A span that starts before the end of an earlier one belongs to that one's mark.
        fresh = F.filter(
            F.zip_with(spans, before, lambda x, at: F.struct(at.alias("from"), x["start"].alias("to"))),
            lambda x: x["to"] >= x["from"],
        )
        pieces = F.transform(fresh, lambda x: F.concat(cut(x["from"], x["to"], blocks), F.lit(mark)))
        end = F.array_max(F.transform(spans, lambda x: x["end"]))
        return F.concat(F.array_join(pieces, ""), cut(end, F.length(text), blocks))

    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, _let(parts, joined)).otherwise(text)


def redact_documents(spark, docs):
    """The rows and columns of ``docs`` with secrets in ``text`` replaced, ``n_chars`` to match."""
    names = docs.columns
    own = {c: f"own_{i}" for i, c in enumerate(names)}
    found = find_secrets(
        spark,
        docs.select(*[F.col(c).alias(n) for c, n in own.items()]),
        carry=list(own.values()),
        id_col=own["doc_id"],
        text_col=own["text"],
    )
    any_found = F.size("secrets") > 0
    text = F.col(own["text"])
    out = found.withColumn("clean", redact(text, F.col("secrets")))
    columns = {c: F.col(n) for c, n in own.items()} | {"text": F.col("clean")}
    if "n_chars" in own:
        size = F.length("clean").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(any_found, size).otherwise(columns["n_chars"])
    return out.select(*[column.alias(c) for c, column in columns.items()])
