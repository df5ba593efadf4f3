"""Word lists of the prose grammars. A module may add its own to each.

All are fixed values: results depend on exactly these words.
"""

from __future__ import annotations

#: Verbs that say nothing unless their object is concrete.
WEAK_VERBS = ("support", "handle", "manage", "process", r"deal\s+with", "provide", "enable", r"be\s+able\s+to")
#: What makes the object of a weak verb concrete.
QUALIFIERS = r"\b(?:by|using|via|per|through|according to|that|which|within|before|after|only|not)\b|\bin order\b|\bidempotent|[0-9<>%`]"
#: Abstract objects and manners.
ABSTRACT = (
    "flexibility", "extensibility", "robustness", "scalability", "usability", "reliability", "maintainability", "interoperability", "capabilit(?:y|ies)", "functionality", "complexity",
    "seamless(?:ly)?", "gracefully", "appropriately", "efficiently", "properly", "correctly", "reliably", "acceptable", "reasonable", "sufficient", "adequate", "user-friendly", "intuitive",
    "performant", "flexible", "robust", "scalable",
)
ABSTRACT_AS = r"\bas (?:needed|appropriate|required|possible)\b"
#: First words that stand for a trigger but aren't one of the patterns'.
OTHER_TRIGGERS = ("on", "upon", "after", "before", "once", "during")
#: Terms that leave a reader unsure what satisfies a statement.
AMBIGUOUS = (
    "adequate", "appropriate", "sufficient", "reasonable", "acceptable", "as needed", "as appropriate", "as required", "if possible", "if practical", "where appropriate", "user-friendly",
    "easy to use", "robust", "flexible", "seamless", "efficient", "effective", "optimal", "minimize", "maximize", "optimize", "improve", "enhance", "best", "fastest", "state-of-the-art",
    "and/or", "etc", "and so on",
)
MODALS = ("shall", "should", "may", "must")
#: Words after ``by`` that name no agent.
NO_AGENT = (
    "name", "names", "id", "ids", "key", "keys", "index", "order", "path", "paths", "date", "dates", "size", "length", "position", "column", "columns", "row", "rows", "line", "lines", "type",
    "types", "kind", "kinds", "value", "values", "priority", "timestamp", "timestamps", "default", "convention", "construction", "definition",
)
#: Base forms of verbs whose result can be observed.
OBSERVABLE = (
    "accept", "allow", "apply", "approve", "assign", "block", "call", "carry", "catch", "change", "clean", "contain", "count", "create", "declare", "define", "delete", "deny", "detect",
    "discard", "distinguish", "emit", "enforce", "equal", "exceed", "execute", "exist", "exit", "expose", "extract", "fail", "filter", "ignore", "include", "inherit", "insert", "load", "log",
    "mark", "match", "merge", "mount", "omit", "parse", "pass", "persist", "preserve", "print", "produce", "propagate", "publish", "raise", "rank", "read", "receive", "record", "reject",
    "remove", "render", "replace", "report", "resolve", "restore", "resume", "retry", "return", "route", "run", "save", "select", "send", "skip", "sort", "split", "start", "stop", "store",
    "succeed", "throw", "track", "transition", "trigger", "update", "validate", "write", "yield",
)
#: Past forms that no ending gives.
IRREGULAR = {
    "write": ("wrote", "written"), "read": ("read",), "send": ("sent",), "build": ("built",), "keep": ("kept",), "make": ("made",), "find": ("found",), "hold": ("held",), "run": ("ran",),
    "throw": ("threw", "thrown"), "catch": ("caught",), "leave": ("left",), "lose": ("lost",), "show": ("shown",), "give": ("gave", "given"), "take": ("took", "taken"), "see": ("saw", "seen"),
    "set": ("set",), "put": ("put",), "cut": ("cut",),
}
#: Predicates that claim nothing that could be checked.
VACUOUS = (
    "works", "working", "behaves", "behave", "functions correctly", "functions properly", "functions as expected", "functions independently", "is correct", "is successful", "is fine", "is ok",
    "work correctly", "work properly", "work as expected",
)
#: Signs of a predicate, and of one whose copula is left out.
COPULAS = r"\b(?:shall|should|must|may|can|cannot|will|won't|would|does|doesn't|do|don't|is|are|was|were|be|been|being|has|have|had)\b"
PAST = r"\b(?:built|sent|written|wrote|kept|made|found|held|ran|begun|threw|thrown|caught|left|lost|shown|drawn|gave|given|took|taken|saw|seen|set|put|cut|read)\b"
INFLECTED = r"\b\w+(?:s|ed|ing)\b"
ELIDED = (
    r"\A\s*(?:no|none|neither|only|exactly|at most|at least)\b|\b(?:present|absent|missing|visible|hidden|identical|independent|equal|equivalent|unique|empty|non-empty|consistent|idempotent|"
    r"deterministic|available|unavailable|immutable|atomic|monotonic|stable|reachable|unreachable|distinct|sorted|ordered|unchanged)\b"
)
IMPERATIVE = (
    r"\A\s*(?:add|attach|detach|remove|delete|create|assign|unassign|rename|register|unregister|enable|disable|restore|send|fetch|retrieve|reject|accept|validate|verify|apply|unlink|publish|"
    r"revoke|grant|insert|append|prepend|replace|resolve|emit)\s+(?-i:[a-z])\S*(?:\s+\S+)*?\s+(?:to|from|into|onto|in|on|with|for|by|at|of|under|between|against)\s+\S"
)
#: Marks of a negative case, and where a clause ends.
NEGATIVE = r"\b(?:none|no|never|neither|nothing|zero|without|otherwise)\b"
CLAUSE_END = r"(?:;|\.\s|,\s|\s+and\s+|\s+but\s+|\s+while\s+)"

#: The shapes of a property in order of precedence; the patterns of
#: those that structure shows (all must match), and the phrases of the others.
SHAPES = ("round-trip", "idempotence", "ordering", "invariant", "error-case", "lifecycle", "concurrency", "universal", "example", "unclassified")
STRUCTURE = {
    "round-trip": (
        r"\bthen\b|\bfollowed\s+by\b|\bround[- ]?trips?\b|\bround[- ]?tripped\b",
        r"(?:yields|returns|produces|gives|reproduces)\s+the\s+(?:input|original|source)|\bbyte-identical\b|equals\s+the\s+(?:input|original|source)|identical\s+to\s+the\s+(?:input|original|source)|\blosslessly\b|\bround[- ]?trips?\b",
    ),
    "idempotence": (r"\btwice\b|\bagain\b|a\s+second\s+time\b|\brepeatedly\b|\bre-?run\b|\bre-?applied\b", r"\b(?:yields|produces|returns|leaves|equals|matches)\b|the\s+same\b"),
    "ordering": (r"\bsorted\b|\bsort\s+order\b|\bprecedes\b|\bstable\s+order\b|\bfirst-wins\b|\bin\s+(?:corpus|path|input|document|declaration)\s+order\b|\border\s+is\s+preserved\b",),
    "invariant": (r"\balways\b|\bnever\b|\binvariant\b|\bregardless\s+of\b|\bunder\s+any\b|\bfor\s+any\b|\bin\s+every\s+case\b|\bno\s+matter\b",),
}
IDIOMS = {
    "error-case": ("malformed input", "invalid input", "rejects with", "raises an error", "returns an error"),
    "lifecycle": ("state transition", "transitions from", "lifecycle", "in sequence"),
    "concurrency": ("concurrently", "in parallel", "interleaving", "simultaneously"),
}
#: Where a statement's quantifier may stand.
_DETERMINER = r"(?:a|an|any|every|each|all|no)\s+"
QUANTIFIED = (
    rf"\A\W*{_DETERMINER}",
    rf"\A\W*(?:given|when|if|while|where|unless|once|after|before)\s+{_DETERMINER}",
    rf"\A\W*(?:given|when|if|while|where|unless|once|after|before|in|for|following|during|upon)\b[^,]*,\s*{_DETERMINER}",
)
#: Words after which an inflected word is no verb.
MODIFIERS = (
    "a", "an", "the", "any", "every", "each", "all", "no", "its", "their", "his", "her", "our", "your", "this", "that", "these", "those", "some", "one", "two", "both", "either", "neither", "of",
    "in", "to", "from", "with", "for", "on", "at", "by", "into", "over", "under", "per", "via", "across", "between", "about",
)


def plural(term: str) -> str:
    if term[-1:] == "y" and term[-2:-1] not in "aeiou":
        return term[:-1] + "ies"
    return term + ("es" if term.endswith(("s", "x", "z", "ch", "sh")) else "s")


def inflections(verb: str) -> tuple[str, ...]:
    """Base, third person, past and participle, and the irregular past forms."""
    stem = verb[:-1] if verb.endswith("e") else verb
    past = verb[:-1] + "ied" if plural(verb).endswith("ies") else stem + "ed"
    return (verb, plural(verb), past, stem + "ing", *IRREGULAR.get(verb, ()))


def any_of(words) -> str:
    """A pattern of whole words or phrases, with any white space between words."""
    return r"\b(?:" + "|".join(r"\s+".join(w.split()) for w in words) + r")\b"
