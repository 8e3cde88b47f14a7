"""Text classification, parsing and templating as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from causeway.functions import lexicons as lx


def literals(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.expr("cast(array() as array<string>)")


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Whether the text, in lower case, holds one of ``words`` anywhere (not as a pattern)."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [low.contains(w.lower()) for w in words], F.lit(False))


def hits(text: Column, words: Sequence[str]) -> Column:
    """How many of the distinct ``words`` the text holds."""
    low = F.lower(text)
    return reduce(lambda a, b: a + b, [low.contains(w.lower()).cast("int") for w in dict.fromkeys(words)], F.lit(0))


def first_of(pairs: Sequence[tuple[Column, Column | str | float]], default) -> Column:
    """The value of the first condition that holds."""
    lift = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.coalesce(*[F.when(c, lift(v)) for c, v in pairs], lift(default))


def infer_relation(effect: Column) -> Column:
    return first_of([(contains_any(effect, words), name) for name, words in lx.RELATION_VERBS], "affects")


def infer_psp_type(cause: Column, effect: Column, lexicon: dict[str, list[str]] = lx.EDGE_KEYWORDS) -> Column:
    """The edge type that both ends' words speak for."""
    from_p, from_s = contains_any(cause, lexicon["Processing"]), contains_any(cause, lexicon["Structure"])
    to_s, to_p = contains_any(effect, lexicon["Structure"]), contains_any(effect, lexicon["Property"])
    return first_of(
        [
            (from_p & to_s, "Processing_to_Structure"),
            (from_s & to_p, "Structure_to_Property"),
            (from_p & to_p, "Processing_to_Property"),
            (from_s & to_s, "Structure_to_Structure"),
            (from_p & ~to_s & ~to_p, "Processing_to_Structure"),
        ],
        "Processing_to_Property",
    )


def infer_material(source_file: Column) -> Column:
    """The first known name in a file name; an empty or null one gives an empty name."""
    low = F.lower(source_file)
    return first_of([(low.contains(m), m.upper() if len(m) <= lx.SHORT_NAME else m) for m in lx.MATERIALS], "")


def infer_material_extended(source_file: Column) -> Column:
    low = F.lower(source_file)
    plain = infer_material(source_file)
    return F.when(plain != "", plain).otherwise(first_of([(low.contains(k), v) for k, v in lx.MORE_MATERIALS], ""))


def parse_confidence(level: Column) -> Column:
    return first_of([(contains_any(level, words), value) for words, value in lx.CONFIDENCE_WORDS], lx.DEFAULT_CONFIDENCE)


def is_placeholder(label: Column) -> Column:
    """Empty labels, and those that stand for a missing one."""
    trimmed = F.trim(F.coalesce(label, F.lit("")))
    return (trimmed == "") | contains_any(trimmed, ["unknown", "n/a"])


def layer_scores(label: Column, lexicon: dict[str, list[str]]) -> dict[str, Column]:
    return {layer: hits(label, lexicon[layer]) for layer in lx.LAYERS}


def node_layer(label: Column, lexicon: dict[str, list[str]] = lx.NODE_KEYWORDS) -> Column:
    """The layer with most keywords in the label; of equals the earlier one; null without any."""
    s = layer_scores(label, lexicon)
    top = F.greatest(*s.values())
    return F.when(top > 0, first_of([(s[x] == top, x) for x in lx.LAYERS], None))


def name_layer(label: Column, lexicon: dict[str, list[str]] = lx.NAME_KEYWORDS) -> Column:
    """As ``node_layer`` with ties to the later layer, and Processing without any keyword."""
    s = layer_scores(label, lexicon)
    top = F.greatest(*s.values())
    return F.when(top == 0, F.lit("Processing")).otherwise(first_of([(s[x] == top, x) for x in reversed(lx.LAYERS)], None))


def required_layers(question: Column, signals: dict[str, list[str]] = lx.QUESTION_SIGNALS) -> Column:
    """Layers whose signals a question holds, in layer order; all without any; Structure besides a single one."""
    found = F.filter(F.array(*[F.when(contains_any(question, signals[x]), F.lit(x)) for x in lx.LAYERS]), lambda x: x.isNotNull())
    full = literals(lx.LAYERS)
    chosen = F.when(F.size(found) == 0, full).when(F.size(found) == 1, F.array_union(found, literals(["Structure"]))).otherwise(found)
    return F.array_intersect(full, chosen)


def required_layers_by_words(question: Column) -> Column:
    """Layers that the whole words of a question ask for, in layer order; all without any."""
    lists = [F.when(question.rlike(r"(?i)\b(" + "|".join(words) + r")\b"), literals(layers)).otherwise(literals([])) for words, layers in lx.QUESTION_WORDS]
    found = F.array_distinct(F.concat(*lists))
    return F.array_intersect(literals(lx.LAYERS), F.when(F.size(found) == 0, literals(lx.LAYERS)).otherwise(found))


def path_layers(path: Column, lexicon: dict[str, list[str]] = lx.NODE_KEYWORDS) -> Column:
    """The nodes of a path by layer, in path order."""
    of = lambda x: F.coalesce(node_layer(x, lexicon), F.lit("Unknown"))
    own = lambda name: F.filter(path, lambda x: of(x) == name).alias(name)
    return F.struct(*[own(name) for name in [*lx.LAYERS, "Unknown"]])


def layers_covered(path: Column, lexicon: dict[str, list[str]] = lx.NODE_KEYWORDS) -> Column:
    """Distinct layers of a path's nodes, in layer order."""
    return F.array_intersect(literals(lx.LAYERS), F.transform(path, lambda x: node_layer(x, lexicon)))


def psp_chain(processing: Column, structure: Column, prop: Column) -> Column:
    """The two edges of a chain."""
    edge = lambda a, b, kind: F.struct(a.alias("src"), b.alias("dst"), F.lit(kind).alias("psp_type"))
    return F.array(edge(processing, structure, "Processing_to_Structure"), edge(structure, prop, "Structure_to_Property"))


def search_queries(terms: Column, paths: Column, direction: Column) -> Column:
    """At most twelve literature queries: two for each of the first three paths, two for the terms."""
    plain = lambda p: F.replace(F.replace(p, F.lit(" -> "), F.lit(" ")), F.lit("_"), F.lit(" "))
    around = lambda text, phrases: F.array(*[F.concat(F.lit(before), text, F.lit(after)) for before, after in phrases])
    of_paths = F.flatten(F.transform(F.slice(paths, 1, 3), lambda p: around(plain(p), lx.PATH_QUERIES)))
    key = F.array_join(F.slice(F.filter(terms, lambda t: t.isNotNull() & (t != "")), 1, 3), " ")
    of_terms = F.when(direction == "forward", around(key, lx.TERM_QUERIES["forward"])).otherwise(around(key, lx.TERM_QUERIES["inverse"]))
    return F.slice(F.concat(of_paths, of_terms), 1, 12)


def shortened(text: Column, most: int = 300) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def extract_json(text: Column) -> Column:
    """The first JSON object of a free text that parses: a block marked as JSON, any block, the outermost braces."""
    fenced = F.regexp_extract(text, r"(?s)```json\s*(.*?)\s*```", 1)
    block = F.regexp_extract(text, r"(?s)```\s*(.*?)\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.coalesce(*[F.when((c != "") & F.try_parse_json(c).isNotNull(), c) for c in (fenced, block, braces)])


def parse_pairs(pairs: Column) -> Column:
    """``key=value`` strings as a map, trimmed; the last of a key wins; pairs without a key or ``=`` raise."""
    key = lambda p: F.trim(F.substring_index(p, "=", 1))
    checked = F.transform(
        pairs,
        lambda p: F.when(~p.contains("=") | (key(p) == ""), F.raise_error(F.concat(F.lit("not key=value: "), p))).otherwise(F.struct(key(p).alias("key"), F.trim(p.substr(F.instr(p, "=") + 1, F.length(p))).alias("value"))),
    )
    later = F.transform(checked, lambda e, i: F.struct(e.alias("e"), F.exists(F.slice(checked, i + 2, F.size(checked)), lambda o: o["key"] == e["key"]).alias("again")))
    return F.map_from_entries(F.transform(F.filter(later, lambda x: ~x["again"]), lambda x: x["e"]))


def words(text: Column) -> Column:
    """Distinct words between white space, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def overlap_entails(claim: Column, evidence: Column, least: float = 0.4) -> Column:
    """Whether more than ``least`` of the claim's words are among the evidence's."""
    own = words(claim)
    return F.size(F.array_intersect(own, words(evidence))) / F.greatest(F.size(own), F.lit(1)) > least


def atomic_claims(text: Column) -> Column:
    """Sentences, cut at relative and joining clauses; claims of ten characters or fewer go.

    Sentences end at a full stop, question or exclamation mark before white space."""
    sentences = F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001")
    parts = F.flatten(F.transform(sentences, lambda s: F.split(s, r",\s*(?:which|that|and)\s+")))
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: F.length(p) > 10)


STOPWORDS = ["the", "and", "for", "with", "that", "this", "from", "are", "was", "were", "has", "have", "its", "into", "which", "than", "then", "but", "not", "can", "will", "due", "via"]


def key_terms(text: Column) -> Column:
    """Distinct words of three or more letters that are no stop words: a stand-in for nouns, stated as such."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z0-9_-]{2,}"), F.lit(0))
    return F.array_sort(F.array_except(F.array_distinct(found), literals(STOPWORDS)))


def causal_edges(step: Column) -> Column:
    """(source, verb, target) for "word verb word" in a reasoning step: a stand-in for parsing, stated as such."""
    pattern = r"(\w+)\s+(" + "|".join(lx.CAUSAL_VERBS) + r")\s+(\w+)"
    get = lambda m, g: F.regexp_extract(m, pattern, g)
    return F.transform(F.regexp_extract_all(step, F.lit(pattern), F.lit(0)), lambda m: F.struct(get(m, 1).alias("source"), get(m, 2).alias("verb"), get(m, 3).alias("target")))


def merged_params(base: Column, extra: Column) -> Column:
    """Two maps as one; the second wins."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(extra, k)), extra)


def trace_steps(explanation: Column) -> Column:
    """Trace steps of an explanation in JSON: its chain of thought, each with confidence 0.8 and open layers."""
    chain = F.get(F.array(F.from_json(explanation, "chain_of_thought array<string>")), 0)["chain_of_thought"]
    return F.transform(
        F.coalesce(chain, F.expr("cast(array() as array<string>)")),
        lambda s: F.struct(F.lit("").alias("processing"), F.lit("").alias("structure"), F.lit("").alias("property"), s.alias("evidence_text"), F.lit(0.8).alias("confidence")),
    )


def edge_driven_layer(as_p: Column, as_s: Column, as_prop: Column, label: Column) -> Column:
    """A node's layer by the edges at it; Structure where they disagree and it is among them; else by its words.

    ``as_p``: it starts a P-edge; ``as_s``: a P-to-S edge ends there; ``as_prop``: an S-to-P edge ends there."""
    low = F.lower(label)
    return first_of(
        [
            (as_s, "Structure"),
            (as_p, "Processing"),
            (as_prop, "Property"),
            *[(low.rlike(pattern), layer) for pattern, layer in lx.LAYER_PATTERNS],
        ],
        "Structure",
    )


def scaled(value: Column, low: float, high: float) -> Column:
    """Position between two ends in per cent, cut to 0 and 100."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), (value - low) / (high - low) * 100))
