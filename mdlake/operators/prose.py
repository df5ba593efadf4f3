"""Plain language and requirement grammars, as regular expressions over columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mdlake.functions import text as t
from mdlake.functions import vocabulary as v
from mdlake.operators import parse


def reader_lines(docs: DataFrame, body: str = "body", keep: tuple[str, ...] = ("doc_key",)) -> DataFrame:
    """``line, kind, text`` of what a reader sees: headings, items, quotes, table
    cells and paragraphs, without code, comments, rules and inline marks. ``line``
    is the place in the body, from 0."""
    seen = parse.visible_lines(F.col(body))
    rows = docs.select(*keep, F.explode(seen).alias("seen")).select(*keep, F.col("seen.line").alias("line"), F.col("seen.text").alias("raw"))
    rows = rows.where(~F.rlike("raw", F.lit(r"\A(?:\s*| {4}.*|\t.*|\s{0,3}(?:[-*_]\s*){3,}|\s*\|?[\s:|-]+\|?\s*)\z")))
    kind = (
        F.when(F.rlike("raw", F.lit(r"\A {0,3}#{1,6}\s")), "heading").when(F.rlike("raw", F.lit(r"\A\s*(?:[-*+]|\d+[.)])\s")), "item")
        .when(F.rlike("raw", F.lit(r"\A\s*>\s*\[!")), "alert").when(F.rlike("raw", F.lit(r"\A\s*>")), "quote").when(F.contains("raw", F.lit("|")), "cell").otherwise("paragraph")
    )
    text = F.regexp_replace("raw", r"\A\s*(?:#{1,6}\s+|(?:[-*+]|\d+[.)])\s+|>\s*(?:\[![A-Za-z]+\]\s*)?)", "")
    return rows.select(*keep, "line", kind.alias("kind"), inline(text).alias("text"))


def inline(text: Column) -> Column:
    """Without inline marks: links as their text, code spans, emphasis and HTML away."""
    for pattern, by in ((r"!?\[([^\]]*)\]\([^)]*\)", "$1"), (r"`[^`]*`", " "), (r"</?[A-Za-z][^>]*>", ""), (r"\*\*|__|(?<!\w)[*_](?=\S)|(?<=\S)[*_](?!\w)", "")):
        text = F.regexp_replace(text, pattern, by)
    return t.strip(text)


def long_sentences(rows: DataFrame, limit: int, text: str = "text") -> DataFrame:
    """``sentence, words`` of sentences of more words than ``limit``."""
    s = rows.withColumn("sentence", F.explode(t.sentences(F.col(text))))
    return s.withColumn("words", t.word_count(F.col("sentence"))).where(F.col("words") > limit).withColumn("sentence", F.substring("sentence", 1, 160))


def heading_skips(sections: DataFrame, step: int = 1, by: tuple[str, ...] = ("doc_key",)) -> DataFrame:
    """Headings more than ``step`` levels below the one before."""
    before = F.lag("level").over(W.partitionBy(*by).orderBy("section_no"))
    return sections.withColumn("before", before).where(F.col("level") > F.col("before") + step).select(*by, "section_no", "heading", "before", "level")


_ACRONYM = r"(?<![A-Za-z0-9-])([A-Z0-9][A-Z0-9-]{1,11})(?![A-Za-z0-9-])"


def undefined_acronyms(docs: DataFrame, known: tuple[str, ...] = (), text: str = "text", by: str = "doc_key") -> DataFrame:
    """``acronym`` once a document: two or more capitals, no identifier with a
    number at its end, not defined before as ``Long Form (LF)``."""
    found = docs.select(by, text, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(_ACRONYM), 1))).alias("acronym"))
    found = found.where((F.length(F.regexp_replace("acronym", "[^A-Z]", "")) >= 2) & ~F.rlike("acronym", F.lit(r"\A[A-Z]+-\d+\z")) & ~F.rlike("acronym", F.lit(r"-\z")))
    if known:
        found = found.where(~F.col("acronym").isin(*known))
    defined = F.instr(F.col(text), F.concat(F.lit("("), F.col("acronym"), F.lit(")")))
    first = F.instr(F.col(text), F.col("acronym"))
    return found.where((defined == 0) | (first < defined)).select(by, "acronym")


@dataclass(frozen=True)
class Profile:
    """A named, versioned profile of plain language; no value has a default but the scope."""

    name: str
    version: str
    sentence_word_limit: int
    max_heading_level_step: int
    document_types: tuple[str, ...] = ()
    known_acronyms: tuple[str, ...] = ()
    ignored_uppercase_terms: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        terms = (*self.known_acronyms, *self.ignored_uppercase_terms)
        bad = {
            "an empty name": not self.name.strip(), "an empty version": not self.version.strip(), "no sentence limit": self.sentence_word_limit < 1,
            "a heading step outside 1..5": not 1 <= self.max_heading_level_step <= 5, "an empty document type": not all(k.strip() for k in self.document_types),
            "a term that is no acronym": not all(re.fullmatch(r"[A-Z0-9-]{2,12}", x) for x in terms),
        }
        problems = [name for name, found in bad.items() if found]
        if problems:
            raise ValueError(f"the profile {self.name!r} has {', '.join(problems)}")


def check_profile(docs: DataFrame, profile: Profile, skipped: DataFrame | None = None) -> dict[str, DataFrame]:
    """``findings`` (``key, rule, line, message``), ``skipped`` (``key, reason``) and
    ``counts`` of documents (``key, type, body``) under a profile. Every document is
    read or skipped with a reason; ``skipped`` adds those that were no documents."""
    applies = F.col("type").isin(*profile.document_types) if profile.document_types else F.lit(True)
    applies = F.coalesce(applies, F.lit(False))
    mine = docs.where(applies)
    rows = reader_lines(mine, keep=("key",)).where("text <> ''")
    silent = mine.select("key").join(rows.select("key").distinct(), "key", "left_anti").select("key", F.lit("no-readable-prose").alias("reason"))
    left = docs.where(~applies).select("key", F.lit("profile-not-applicable").alias("reason")).unionByName(silent)
    if skipped is not None:
        left = left.unionByName(skipped.select("key", "reason"))
    prose_ = rows.where("kind IN ('paragraph', 'item', 'quote', 'alert')")
    long = long_sentences(prose_, profile.sentence_word_limit).select("key", F.lit("sentence-length").alias("rule"), "line", "sentence")
    jumps = heading_skips(parse.sections(mine, keep=("key",)), profile.max_heading_level_step, ("key",)).select("key", F.lit("heading-skip").alias("rule"), F.lit(None).cast("int").alias("line"), F.col("heading").alias("sentence"))
    # Definitions count wherever they stand before; the first use of an acronym has its line.
    known = (*profile.known_acronyms, *profile.ignored_uppercase_terms)
    whole = prose_.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))
    loose = undefined_acronyms(whole, known, by="key").select("key", F.lit("undefined-acronym").alias("rule"), F.lit(None).cast("int").alias("line"), F.col("acronym").alias("sentence"))
    findings = long.unionByName(jumps).unionByName(loose).withColumnRenamed("sentence", "message")
    counts = docs.agg(F.count("*").alias("documents_examined")).join(counters(rows, "key"))
    return {"findings": findings, "skipped": left.distinct(), "counts": counts.select(F.lit(profile.name).alias("profile"), F.lit(profile.version).alias("version"), "*")}


def _has(s: Column, pattern: str) -> Column:
    return F.rlike(s, F.lit("(?iU)" + pattern))


def plain(statement: Column) -> Column:
    """Without links and bold marks, which may stand in one another."""
    for _ in range(2):
        statement = F.replace(F.regexp_replace(statement, r"\[([^\]]*)\]\([^)]*\)", "$1"), F.lit("**"), F.lit(""))
    return statement


_SPAN = r"(?<!`)(`+)(?!`).+?(?<!`)\1(?!`)"


def masked(statement: Column) -> Column:
    """With the contents of code spans gone: a quoted keyword is a mention, not a use."""
    return F.regexp_replace(statement, "(?s)" + _SPAN, "$1x$1")


def _first_word(lower: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(lower, r"(?U)\A\s*(\S+)", 1), r"\A[^a-z]+|[^a-z]+\z", "")


def _no_subject(lower: Column) -> Column:
    """Whether the main clause names nothing before ``shall``. It begins after the
    comma of a leading trigger, and after ``then``."""
    led = _first_word(lower).isin("when", "while", "where", "if") & F.contains(lower, F.lit(", "))
    main = F.when(led, F.regexp_extract(lower, r"(?s)\A.*?, (.*)\z", 1)).otherwise(lower)
    before = t.strip(F.regexp_replace(t.strip(F.regexp_extract(main, r"(?s)\A(.*?)shall", 1)), r"\Athen", ""))
    return F.contains(main, F.lit("shall")) & (before == "")


def ears_pattern(statement: Column) -> Column:
    """The requirement pattern: without ``shall`` unclassifiable; two or more distinct
    trigger words complex; else the first word decides, else a subject makes it ubiquitous."""
    s = F.lower(plain(statement))
    triggers = F.size(F.array_distinct(F.regexp_extract_all(s, F.lit(r"(?<![a-z])(when|while|where|if)(?![a-z])"), 1)))
    first = _first_word(s)
    return (
        F.when(~_has(s, r"\bshall\b"), "unclassifiable").when(triggers >= 2, "complex").when(first == "when", "event").when(first == "while", "state")
        .when(first == "where", "optional").when(first == "if", "unwanted").when(_no_subject(s), "unclassifiable").otherwise("ubiquitous")
    )


def _vague(clause: Column, lead: str, lexicon: tuple[str, ...]) -> Column:
    """Whether the first weak verb after ``lead`` has no concrete object. A
    capability is always vague; a qualifier makes the object concrete, an abstract
    quality vague again; a term of the lexicon is concrete."""
    s = F.lower(plain(clause))
    pattern = rf"(?sU)\A.*?\b{lead}({'|'.join(v.WEAK_VERBS)})\b(.*)\z"
    verb, rest = F.regexp_extract(s, pattern, 1), F.regexp_extract(s, pattern, 2)
    terms = [x for term in lexicon for x in (term, v.plural(term))]
    known = _has(rest, v.any_of(terms)) if terms else F.lit(False)
    abstract = _has(rest, rf"\b(?:{'|'.join(v.ABSTRACT)})\b|{v.ABSTRACT_AS}")
    return (verb != "") & (_has(verb, r"\Abe\s") | (~_has(rest, v.QUALIFIERS) & (abstract | ~known)))


def _checks(*fails: Column) -> Column:
    return F.array_sort(F.filter(F.array(*fails), lambda c: c.isNotNull()))


def ears_checks(statement: Column, lexicon: tuple[str, ...] = ()) -> Column:
    """Sorted checks that a statement fails; ``lexicon`` has terms that are concrete."""
    s = F.lower(plain(statement))
    shall = F.size(F.regexp_extract_all(F.lower(statement), F.lit(r"(?U)\b(shall)\b"), 1))
    return _checks(
        F.when(ears_pattern(statement) == "unclassifiable", "unclassifiable"),
        F.when(shall > 1, "non-singular"),
        F.when(_no_subject(s), "missing-subject"),
        F.when(_vague(statement, r"shall\s+(?:not\s+)?", lexicon), "vague-response"),
        F.when(_has(s, r"\bshall\b") & _first_word(s).isin(*v.OTHER_TRIGGERS), "non-canonical-trigger"),
    )


def _signal(s: Column, lexicon: tuple[str, ...], observable: tuple[str, ...]) -> Column:
    """Something that can be checked from outside: a figure, bound or code span, a term, an observable verb."""
    terms = [x for term in lexicon for x in (term, v.plural(term))]
    verbs = [x for verb in (*v.OBSERVABLE, *observable) for x in v.inflections(verb)]
    return _has(s, "[0-9<>%`]") | _has(s, v.any_of([*terms, *verbs]))


def criterion_shape(statement: Column, lexicon: tuple[str, ...] = (), observable: tuple[str, ...] = ()) -> Column:
    """``obligation`` (a requirement pattern), ``given-when-then``, ``assertion`` (it has
    a predicate) or ``unstructured``."""
    m, s = F.lower(plain(masked(statement))), plain(statement)
    predicate = _signal(s, lexicon, observable) | _has(s, v.COPULAS) | _has(s, v.INFLECTED) | _has(s, v.PAST) | _has(s, v.ELIDED) | _has(s, v.IMPERATIVE)
    return (
        F.when(ears_pattern(masked(statement)) != "unclassifiable", "obligation").when(_has(m, r"(?s)\A(?:(?!\bthen\b).)*\b(?:given|when)\b.*\bthen\b"), "given-when-then")
        .when(predicate, "assertion").otherwise("unstructured")
    )


def _obligations(m: Column, shape: Column) -> Column:
    """How many obligations a criterion bundles: its modal verbs, else the results
    of a given-when-then. One of two that says the first negatively is not counted."""
    shall, then = (F.size(F.regexp_extract_all(m, F.lit(rf"(?U)\b({w})\b"), 1)) for w in ("shall", "then"))
    n = F.when(shall > 0, shall).when(shape == "given-when-then", then).otherwise(0)
    between, second = (F.regexp_extract(m, r"(?sU)\A.*?\bshall\b(.*?)(\bshall\b.*)\z", i) for i in (1, 2))
    clause = F.concat(F.regexp_replace(between, rf"(?sU)\A.*{v.CLAUSE_END}", ""), second)
    negative = (shall > 0) & (_has(second, r"\Ashall\s+(?:not|never)\b") | _has(clause, v.NEGATIVE))
    return F.when((n == 2) & negative, 1).otherwise(n)


def _after(statement: Column, word: str) -> Column:
    """What follows the first use of a word outside code spans; null without."""
    found = F.regexp_extract(statement, rf"(?isU)\A(?>{_SPAN}|[^`]|`)*?\b{word}\b(.*)\z", 2)
    return F.when(_has(masked(statement), rf"\b{word}\b"), found)


def criterion_checks(statement: Column, lexicon: tuple[str, ...] = (), observable: tuple[str, ...] = (), vacuous: tuple[str, ...] = ()) -> Column:
    """Sorted checks that a criterion fails. A criterion states its outcome: the
    clause after ``shall`` or ``then`` where there is one, else all of it."""
    shape = criterion_shape(statement, lexicon, observable)
    outcome = F.coalesce(F.when(shape == "obligation", _after(statement, "shall")).when(shape == "given-when-then", _after(statement, "then")), statement)
    empty = _has(outcome, v.any_of([*v.VACUOUS, *vacuous])) & ~_signal(plain(statement), lexicon, observable)
    return _checks(
        F.when(shape == "unstructured", "unclassifiable"),
        F.when(shape.isin("obligation", "given-when-then"), "non-canonical-shape"),
        F.when(_obligations(F.lower(plain(masked(statement))), shape) > 1, "non-singular"),
        F.when(_vague(outcome, "", lexicon), "vague-response"),
        F.when(empty, "vacuous-outcome"),
    )


def _predicate(m: Column) -> Column:
    """A modal, copula or past form, or an inflected word that stands where a verb may."""
    weak = rf"(?<!-)(?<!\b(?:{'|'.join(v.MODIFIERS)})\s{{1,4}}){v.INFLECTED}(?!-)"
    return _has(m, v.COPULAS) | _has(m, v.PAST) | _has(m, weak)


def _structural_shape(m: Column) -> Column:
    out = F.when(F.lit(False), "")
    for shape, patterns in v.STRUCTURE.items():
        hit = F.lit(True)
        for p in patterns:
            hit = hit & _has(m, p)
        out = out.when(hit, shape)
    for p in v.QUANTIFIED:
        out = out.when(_has(m, p), "universal")
    return out.when(_predicate(m), "example").otherwise("unclassified")


def property_shape(statement: Column, idioms: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The shape of a criterion, the first of ``SHAPES`` by its structure or by a
    declared phrase. ``idioms`` adds phrases to shapes."""
    m = masked(statement)
    place = lambda s: F.array_position(F.array(*[F.lit(x) for x in v.SHAPES]), s)
    declared = F.lit(len(v.SHAPES)).cast("long")
    merged = {k: (*v.IDIOMS.get(k, ()), *(idioms or {}).get(k, ())) for k in v.SHAPES}
    for shape in reversed(v.SHAPES):
        if merged[shape]:
            declared = F.when(_has(m, v.any_of(merged[shape])), F.lit(v.SHAPES.index(shape) + 1).cast("long")).otherwise(declared)
    return F.element_at(F.array(*[F.lit(x) for x in v.SHAPES]), F.least(place(_structural_shape(m)), declared).cast("int"))


def property_extraction(statement: Column, idioms: dict[str, tuple[str, ...]] | None = None) -> Column:
    """``extractable`` where the structure quantifies and there is a predicate to test;
    else metamorphic shapes are ``candidate``, the others ``not-extractable``."""
    m = masked(statement)
    ready = ~_structural_shape(m).isin("example", "unclassified") & _predicate(m)
    return F.when(ready, "extractable").when(property_shape(statement, idioms).isin("round-trip", "idempotence", "ordering", "invariant"), "candidate").otherwise("not-extractable")


def quality_checks(statement: Column, ambiguous: tuple[str, ...] = ()) -> Column:
    """Sorted: ambiguous terms (with a short ending), ``shall be`` with a participle and
    no agent, modal verbs of different strength. Code spans are mentions."""
    m = F.lower(masked(plain(statement)))
    terms = "|".join(re.escape(x) for x in (*v.AMBIGUOUS, *ambiguous))
    rest = F.regexp_extract(m, r"(?sU)\A.*?\bshall\s+be\s+[a-z]+(?:ed|en)\b(.*)\z", 1)
    agent = rf"(?<![\p{{L}}\p{{N}}])by\s+(?:(?:the|a|an)\s+)?+(?!(?:the|a|an)\z|[^\p{{L}}\p{{N}}\s]*(?:\d|(?:{'|'.join(v.NO_AGENT)})[^\p{{L}}\p{{N}}\s]*(?:\s|\z)))[^\p{{L}}\p{{N}}\s]*[\p{{L}}]"
    modals = sum((F.when(_has(m, rf"\b{w}\b"), 1).otherwise(0) for w in v.MODALS), F.lit(0))
    return _checks(
        F.when(_has(m, rf"(?<![\p{{L}}\p{{N}}])(?:{terms})(?:s|d|ed|ing|es)?(?!\p{{L}})"), "ambiguous-term"),
        F.when(_has(m, r"\bshall\s+be\s+[a-z]+(?:ed|en)\b") & ~_has(rest, agent), "agentless-passive"),
        F.when(modals > 1, "mixed-modal"),
    )


def histogram(findings: DataFrame) -> DataFrame:
    """Counts by the ``[grammar:check]`` prefix of messages."""
    name = F.regexp_extract("message", r"\A\[([\w-]+:[\w-]+)\]", 1)
    return findings.groupBy(name.alias("check")).agg(F.count("*").alias("n")).where("check <> ''").orderBy("check")


def counters(lines: DataFrame, by: str = "doc_key") -> DataFrame:
    return lines.agg(F.countDistinct(by).alias("readable_documents"), F.count("*").alias("readable_blocks"))
