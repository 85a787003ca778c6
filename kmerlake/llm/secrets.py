"""Secret scans over a trigram index, in Spark's own functions.

Every rule is a regular expression.  From its syntax tree a Boolean query over
trigrams is derived: trigrams that any match must hold, as an "or" of "and"s.
The index has a posting (trigram, document) for each trigram the rules ask for.
Counting a clause's postings per document intersects them; documents with a full
clause are the rule's candidates, and only there the expression itself runs.  A
rule without mandatory trigrams reads every text.

Postings are counted per document before they are shuffled and there are at most
as many as the rules' trigrams, so no key is hot.  The candidates go to the texts:
broadcast when they are few (checked), so that no text is shuffled, else by a join
on the id.  Null text counts as empty.  Rows that share an id (or have none) share
candidates, but each row is verified on its own text and gives its own output row.
Texts are read whole; the time for a text is linear in its length but for the
positions of its matches, which are added up in blocks.  Other columns, whatever
their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as C, _parser

from pyspark.sql import Column, DataFrame, functions as F

from kmerlake.llm.located import located, span_text, with_kind
from kmerlake.llm.tables import cut, small


@dataclass(frozen=True)
class Rule:
    """A kind of secret: the matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    Rule("assign", _ASSIGN, group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}"),  # a run of 24 or more is found whole either way
)
MORE = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + MORE

#: A query is a list of clauses, each a set of trigrams; None means "any text".
Query = list[frozenset[str]] | None


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    return a if len(a) * len(b) > 64 else [x | y for x in a for y in b]


def _asked(strings: set[str]) -> Query:
    clauses = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings]
    return clauses if all(clauses) else None


def _walk(tree) -> tuple[set[str] | None, Query]:
    """The strings a part matches exactly (None if not a few), and what it asks for."""
    now, exact, query = {""}, True, None

    def flush() -> None:
        nonlocal now, exact, query
        query, now, exact = _both(query, _asked(now)), {""}, False

    for op, arg in tree:
        few: set[str] | None = None
        asked: Query = None
        if op is C.LITERAL:
            few = {chr(arg).lower()}
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg) and len(arg) <= 8:
            few = {chr(c).lower() for _, c in arg}
        elif op is C.SUBPATTERN:
            few, asked = _walk(arg[-1])
        elif op is C.BRANCH:
            parts = [_walk(p) for p in arg[1]]
            if all(p[0] is not None for p in parts):
                few = set().union(*(p[0] for p in parts))
            else:
                each = [p[1] if p[0] is None else _asked(p[0]) for p in parts]
                asked = None if any(e is None for e in each) else [c for e in each for c in e]
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, most, part = arg
            inner, inner_asked = _walk(part)
            if (least, most) == (0, 1) and inner is not None:
                few = inner | {""}
            elif inner is not None and least == most and len(inner) == 1:
                few = {next(iter(inner)) * least}
            elif least:
                asked = inner_asked if inner is None else _asked(inner)
        if few is not None and len(now) * len(few) <= 64:
            now = {a + b for a in now for b in few}
        else:
            flush()
            if few is not None:
                now = set(few)
            query = _both(query, asked)
    if exact:
        return now, None
    flush()
    return None, query


def trigram_query(pattern: str) -> Query:
    """What lower-case trigrams any match of ``pattern`` holds, whatever its case."""
    exact, query = _walk(_parser.parse(pattern))
    return query if exact is None else _asked(exact)


def trigram_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id) of the given trigrams over lower-cased texts."""
    wanted = F.array(*[F.lit(t) for t in trigrams])
    present = F.transform(F.array(F.lower("text")), lambda low: F.filter(wanted, lambda t: F.contains(low, t)))[0]
    return docs.where("text is not null").select("doc_id", F.explode(present).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id and the kinds of the rules that the index lets through."""
    clauses = [(rule.kind, n, len(clause), t) for rule in rules for n, clause in enumerate(trigram_query(rule.pattern) or []) for t in sorted(clause)]
    asked = index.sparkSession.createDataFrame(clauses, "kind string, clause int, needed int, trigram string")
    held = index.join(F.broadcast(asked), "trigram").groupBy("doc_id", "kind", "clause", "needed").agg(F.countDistinct("trigram").alias("n"))
    return held.where("n = needed").groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and ``spans``, an array of start, order (of the rule), end and kind, sorted."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = {r.kind: trigram_query(r.pattern) for r in rules}
    trigrams = sorted({t for q in asked.values() for c in q or [] for t in c})
    found = cut(candidates(trigram_index(texts, trigrams), rules).withColumnRenamed("doc_id", "candidate"))
    found = F.broadcast(found) if small(found) else found
    joined = texts.join(found, texts["doc_id"].eqNullSafe(found["candidate"]), "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"))

    def spans(rule: Rule, order: int) -> Column:
        text = F.col("text") if asked[rule.kind] is None else F.when(F.array_contains("kinds", rule.kind), F.col("text"))
        hits = located(text, rule.pattern)
        if rule.least:
            hits = F.filter(hits, lambda s: F.length(F.regexp_extract(s["value"], rule.pattern, rule.group)) >= rule.least)
        return with_kind(hits, rule.kind, order)

    return joined.select("doc_id", F.array_sort(F.concat(*[spans(r, i) for i, r in enumerate(rules)])).alias("spans"))


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans, per row."""
    found = find_secrets(docs)
    base = F.filter("spans", lambda s: s["order"] < len(BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE], F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
