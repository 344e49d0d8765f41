"""Secret scans through a trigram inverted index.

1. From each rule's expression a Boolean trigram query is derived
   (:mod:`.trigrams`), an OR of ANDs of lower-case trigrams.
2. The inverted index holds a posting ``(trigram, row key)`` for every trigram
   that any rule asks for and every text that contains it. Postings are rows,
   never collected per trigram, so a common trigram is only more rows.
3. Postings are intersected per row key and clause (``bit_or`` of the trigrams
   found, with map-side partials); keys with all trigrams of a clause are the
   rule's candidates.
4. Only candidates are verified by the expression itself. Texts whose key is no
   candidate's are sorted out where they are (bitmaps of the candidates' keys), so
   few texts move. Rules without a mandatory trigram are run over every text.

A row key is a content key: hashes of id and text (96 bits) and the length; rows
that share it have the same id, text and hence the same spans.

Defined results: null text is empty; whole texts are scanned; repeated rows give
a result each; spans that start together are ordered by rule, as listed; matches
of one rule never overlap, those of different rules may; an empty table gives an
empty table; other columns are ignored (:func:`find_secrets`) or passed through
in a struct (:func:`redact`).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, KeyFilter, content_key, let, materialize, prefix_sums, running, text_or_empty
from .trigrams import ANYTHING, trigram_query


@dataclass(frozen=True)
class Rule:
    """``pattern`` is read alike by Java and Python. With a group 1, matches are
    kept whose group 1 has at least ``least`` characters."""

    name: str
    pattern: str
    least: int = 0


# Fixed values. Runs are maximal, so for access and hex the least length may stand in the
# expression; for assign a match that is too short still takes its place, so it is dropped after.
BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
# From BEGIN to END; where END is missing, header lines and the base64 run, to a short last line of it.
# Possessive groups: Java matches them without recursion, so a long run is safe.
_KEY_END = r"[^-]*+(?:-{1,4}[^-]++)*+-{5,}END (?:[A-Z]+ )?PRIVATE KEY(?: BLOCK)?-----"
_KEY_RUN = (r"(?:(?:\s*[A-Za-z-]+: [^\n]*\n)*+(?:[^A-Za-z0-9+/=]{0,12}[A-Za-z0-9+/]{16,}={0,2})++"
            r"(?:\r?\n[^A-Za-z0-9+/=\n]{0,12}[A-Za-z0-9+/]{1,15}={0,2})?)?")
FURTHER_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY(?: BLOCK)?-----(?:%s|%s)" % (_KEY_END, _KEY_RUN)),
    Rule("github_pat", r"github_pat_[A-Za-z0-9_]{22,}"),
    Rule("aws_secret", r"""(?i:aws_?secret_?access_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9/+]{40}"""),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("url_password", r"://[^\s/:@]{1,100}:[^\s/@]{1,100}@"),
)
RULES = BASE_RULES + FURTHER_RULES
MASK = "[SECRET]"
SPANS = "array<struct<start:bigint,kind:int,end:bigint,byte_start:bigint,byte_end:bigint>>"


def rule_spans(text: Column, rule: Rule, kind: int) -> Column:
    """The rule's spans in code points and in bytes of the UTF-8, ends exclusive,
    leftmost and non-overlapping. Positions follow from the lengths of the
    matches and of the text between them."""
    pattern = F.lit(rule.pattern)

    def spans(m: Column) -> Column:
        between = F.split(text, rule.pattern)
        value = F.regexp_extract_all(text, pattern, F.lit(1)) if rule.least else m

        def ends(b: Column, length) -> Column:
            return prefix_sums(F.zip_with(F.slice(b, F.lit(1), F.size(m)), m,
                                          lambda x, y: (length(x) + length(y)).cast("bigint")))

        def build(b: Column) -> Column:
            at = F.zip_with(ends(b, F.char_length), ends(b, F.octet_length),
                            lambda c, o: F.struct(c.alias("chars"), o.alias("bytes")))
            said = F.zip_with(m, value, lambda x, v: F.struct(x.alias("all"), v.alias("value")))
            found = F.zip_with(at, said, lambda e, s: F.struct(
                (e["chars"] - F.char_length(s["all"])).alias("start"), F.lit(kind).alias("kind"),
                e["chars"].alias("end"), (e["bytes"] - F.octet_length(s["all"])).alias("byte_start"),
                e["bytes"].alias("byte_end"), F.char_length(s["value"]).alias("value_chars")))
            return F.filter(found, lambda s: s["value_chars"] >= rule.least)

        return F.transform(let(between, build), lambda s: F.struct(
            s["start"], s["kind"], s["end"], s["byte_start"], s["byte_end"]))

    none = F.array().cast(SPANS)
    return let(F.regexp_extract_all(text, pattern, F.lit(0)),
               lambda m: F.when(F.size(m) > 0, spans(m).cast(SPANS)).otherwise(none))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    d = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return d.select(*content_key(F.col("doc_id"), F.col("text")), "doc_id", "text")


def inverted_index(keyed: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """Postings ``trigram, k1, k2, k3`` of the given trigrams, written once."""
    wanted = F.array(*[F.lit(t) for t in sorted(trigrams)])
    present = let(F.lower("text"), lambda t: F.filter(wanted, lambda g: F.contains(t, g)))
    return materialize(keyed.select(*KEY, F.explode(present).alias("trigram")), "trigram-index")


def candidates(index: DataFrame, queries: dict[int, frozenset]) -> DataFrame:
    """``k1, k2, k3, rules``: bit ``r`` is set where all trigrams of a clause of
    rule ``r`` have a posting of the key."""
    clauses = [(r, c) for r, q in sorted(queries.items()) for c in sorted(q, key=sorted)]
    terms = [F.struct(F.lit(t).alias("trigram"), F.lit(n).alias("clause"), F.lit(r).alias("rule"),
                      F.lit(1 << k).cast("bigint").alias("bit"),
                      F.lit((1 << len(c)) - 1).cast("bigint").alias("all"))
             for n, (r, c) in enumerate(clauses) for k, t in enumerate(sorted(c))]
    asked = index.sparkSession.range(1).select(F.explode(F.array(*terms)).alias("t")).select("t.*")
    met = (index.join(F.broadcast(asked), "trigram")  # as many rows as the rules have trigrams
           .groupBy(*KEY, "rule", "clause").agg(F.bit_or("bit").alias("found"), F.first("all").alias("all"))
           .filter(F.col("found") == F.col("all")))
    return met.groupBy(*KEY).agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``k1, k2, k3, doc_id, spans`` per row: all rules' spans, sorted by start,
    then rule."""
    keyed = _keyed(docs, id_col, text_col)
    queries = {k: trigram_query(r.pattern) for k, r in enumerate(rules)}
    indexed = {k: q for k, q in queries.items() if q != ANYTHING}
    scanned = [rule_spans(F.col("text"), rules[k], k) for k in queries if k not in indexed]
    rows = keyed.select(*KEY, "doc_id", (
        F.flatten(F.array(*scanned)) if scanned else F.array().cast(SPANS)).alias("scanned"))
    if not indexed:
        return rows.select(*KEY, "doc_id", F.array_sort("scanned").alias("spans"))
    index = inverted_index(keyed, sorted({t for q in indexed.values() for c in q for t in c}))
    found = materialize(candidates(index, indexed), "secret-candidates")
    verified = F.flatten(F.array(*[
        F.when(F.col("rules").bitwiseAND(1 << k) != 0, rule_spans(F.col("text"), rules[k], k))
        .otherwise(F.array().cast(SPANS)) for k in indexed]))
    hits = materialize(
        KeyFilter(found, KEY).held(keyed).join(found, KEY).select(*KEY, verified.alias("verified"))
        .filter(F.size("verified") > 0).dropDuplicates(KEY), "secret-hits")
    return rows.join(hits, KEY, "left").select(*KEY, "doc_id", F.array_sort(F.concat(
        "scanned", F.coalesce("verified", F.array().cast(SPANS)))).alias("spans"))


def span_text(spans: Column, rules: Sequence[Rule]) -> Column:
    """``name:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(r.name) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column, mask: str = MASK) -> Column:
    """``text`` with every span replaced; spans that overlap share one mask."""

    def build(b: Column) -> Column:
        upto = running(F.transform(spans, lambda s: s["byte_end"]), lambda a, x: F.greatest(a, x))

        def piece(start: Column, end: Column) -> Column:
            return F.substring(b, (start + 1).cast("int"), (end - start).cast("int")).cast("string")

        return let(upto, lambda u: F.concat(F.array_join(F.transform(spans, lambda s, k: let(
            F.coalesce(F.get(u, k - 1), F.lit(0).cast("bigint")), lambda before: F.when(
                s["byte_start"] >= before, F.concat(piece(before, s["byte_start"]), F.lit(mask)))
            .otherwise(F.lit("")))), ""),
            piece(F.get(u, F.size(u) - 1), F.octet_length(b).cast("bigint"))))

    return F.when(F.size(spans) > 0, let(text.cast("binary"), build)).otherwise(text)


def redact(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text",
           mask: str = MASK, length_col: str | None = None) -> DataFrame:
    """``docs`` with the spans in ``text_col`` masked (and ``length_col`` set to
    the new number of characters). A null text stays null."""
    found = find_secrets(docs, rules, id_col, text_col).filter(F.size("spans") > 0)
    found = materialize(found.select(*KEY, "spans").dropDuplicates(KEY), "secret-spans")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       *content_key(F.col(id_col), text_or_empty(text_col)))
    known = KeyFilter(found, KEY)
    some = known.held(rows).join(found, KEY, "left")
    text = masked(F.col("row")[text_col], F.col("spans"), mask)
    text = F.when(F.col("spans").isNull(), F.col("row")[text_col]).otherwise(text)
    changed = some.select("row", "spans", text.alias("text"))
    kinds = dict(docs.dtypes)
    return changed.select(*[
        F.col("text").alias(c) if c == text_col else
        F.when(F.col("spans").isNull(), F.col("row")[c]).otherwise(
            F.char_length("text").cast(kinds[c])).alias(c) if c == length_col else F.col("row")[c].alias(c)
        for c in docs.columns]).union(known.absent(rows).select("row.*"))
