"""Graph grammars over token sequences.

A grammar is a set of graphs whose nodes hold token conditions; the order of a node's children is the priority of its paths. Matches
are leftmost and do not overlap; of the paths from a start, the first that reaches the end counts, as in a backtracking regular
expression. So a grammar whose only loops are at single nodes is compiled to one: each token's truth vector is one
symbol, each clause a class of symbols, and the matches of a sentence come from one ``regexp_extract_all`` inside the plan.
Grammars with recursion, wider loops, spans as symbols, cross references or more conditions than symbols allow go through a small matcher per sentence.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, MapType, StringType, StructField, StructType

from ..functions.rows import opened as opened_rows
from . import expressions, outputs
from .pointwise import test_of
from ..operators.predicates import Clause, clause_column, parse_clauses, pattern_of, with_macros

#: Symbols are characters of a private range, one for each truth vector of so many clauses.
FIRST_SYMBOL, MOST_CLAUSES = 0xE000, 12
#: Matches whose paths a task remembers.
MOST_KNOWN = 20_000
#: Stands around matches; no symbol.
MARK = "\uf8ff"
EMPTY = ("<E>", "<<E>>", "<X>", "<<X>>")
#: What a call gives to its graph.
_ARGUMENTS = re.compile(r"^\s*:\s*\w+\s*\(([^()]*)\)\s*$")
LOOK = {"?=": "(?=", "?!": "(?!", "?<=": "(?<=", "?<!": "(?<!"}
#: Marks of what must hold, or must not hold, at some token of the sentence.
CROSS = ("=>", "!=>")
ASSERTIONS = (*LOOK, *CROSS)


class GrammarError(ValueError):
    """A grammar that cannot be compiled."""


class EmptyMatchError(GrammarError):
    """The main graph matches without a token."""


class InfiniteLoopError(GrammarError):
    """A loop consumes nothing."""


class LeftRecursionError(GrammarError):
    """A graph calls itself before it consumes a token."""


class UnknownGraphError(GrammarError):
    """A call of a graph that does not exist."""


@dataclass
class Node:
    """``code``: conditions, ``<E>`` (nothing), ``<X>`` (the end), ``:Graph`` (a call), or an assertion's mark before conditions or ``:Graph``.

    A call ``:Graph(name=value, ...)`` sets variables for the graph that it calls. ``guard(sentence, token, variables)`` runs where the code holds,
    before its token is consumed: a false answer turns the path back, a dictionary gives the variables that hold from there on along this path.
    ``$expression$`` in conditions stands for what it comes to with these variables (and ``token``, the attributes of the token that is tested).
    ``output`` is what a path through the node writes (``outputs.parse``); ``script`` is a text that is kept, not run.
    """

    code: str
    children: list[int] = field(default_factory=list)
    guard: Callable[[list[dict], int, dict[str, str]], object] | None = None
    output: str | None = None
    script: str | None = None


@dataclass
class Graph:
    """Nodes by number; the end node has no code that counts."""

    nodes: dict[int, Node]
    start: int
    end: int


@dataclass
class Grammar:
    graphs: dict[str, Graph]
    macros: dict[str, str] = field(default_factory=dict)
    main: str = "Main"
    #: The variables that each sentence starts with, from its tokens' attributes.
    init: Callable[[list[dict]], dict[str, str]] | None = None

    @property
    def scripted(self) -> bool:
        return self.init is not None or any(n.guard or "$" in n.code or _ARGUMENTS.search(n.code) for g in self.graphs.values() for n in g.nodes.values())


def sequence(*codes: str | tuple[str, str]) -> Graph:
    """A graph of one path; a pair is a node's code and its output."""
    pairs = [(c, None) if isinstance(c, str) else c for c in codes]
    nodes = {0: Node("<E>", [1])} | {k + 1: Node(c, [k + 2], output=o) for k, (c, o) in enumerate(pairs)} | {len(codes) + 1: Node("<E>")}
    return Graph(nodes, 0, len(codes) + 1)


def load(text: str) -> Grammar:
    """A grammar from its XML."""
    root = ET.fromstring(text)
    macros = {m.get("key"): m.get("value") for m in root.iter("Macro")}
    graphs = {}
    for g in root.iter("Graph"):
        nodes, start, end = {}, None, None
        for n in g.iter("Node"):
            number = int(n.get("ID"))
            held = [(n.findtext(t) or "").strip() for t in ("MatchingPatternCode", "AnnotationCode", "JScode")]
            nodes[number] = Node(held[0], [int(c.text) for c in n.iter("Child")], output=held[1] or None, script=held[2] or None)
            start = number if n.get("isStartNode") == "true" else start
            end = number if n.get("isEndNode") == "true" or not nodes[number].children and end is None else end
        graphs[g.get("ID")] = Graph(nodes, start, end)
    return Grammar(graphs, macros)


def save(grammar: Grammar) -> str:
    """A grammar as XML; guards and ``init`` are Python and are not part of it."""
    root = ET.Element("Grammar")
    macros = ET.SubElement(root, "Macros")
    for k, v in grammar.macros.items():
        ET.SubElement(macros, "Macro", key=k, value=v)
    for name, graph in grammar.graphs.items():
        g = ET.SubElement(root, "Graph", ID=name)
        for number, node in graph.nodes.items():
            flags = {"isStartNode": "true"} if number == graph.start else {"isEndNode": "true"} if number == graph.end else {}
            n = ET.SubElement(g, "Node", ID=str(number), **flags)
            for tag, text in (("MatchingPatternCode", node.code), ("AnnotationCode", node.output), ("JScode", node.script)):
                if text is not None:
                    ET.SubElement(n, tag).text = text
            for c in node.children:
                ET.SubElement(n, "Child").text = str(c)
    return ET.tostring(root, encoding="unicode")


# --- compile time ----------------------------------------------------------------------------


def kind_of(grammar: Grammar, node: Node) -> tuple[str, str]:
    """A node's kind (empty, call, an assertion's mark, or token) and what it holds."""
    code = with_macros(node.code, grammar.macros).strip()
    if not code or code in EMPTY or code.startswith("//"):
        return "empty", ""
    if code.startswith(":"):
        return "call", code[1:].split("(")[0].strip()
    for mark in sorted(ASSERTIONS, key=len, reverse=True):
        if code.startswith(mark):
            return mark, code[len(mark) :].strip()
    return "token", code


def clauses_of(grammar: Grammar) -> list[Clause]:
    """All distinct clauses, in order of appearance."""
    found: dict[Clause, None] = {}
    for graph in grammar.graphs.values():
        for number, node in graph.nodes.items():
            kind, code = kind_of(grammar, node)
            if number != graph.end and kind not in ("empty", "call") and not code.startswith(":") and "$" not in code:
                found |= dict.fromkeys(parse_clauses(code))
    return list(found)


def check(grammar: Grammar) -> None:
    """Static checks: calls have a graph, no loop consumes nothing, no graph calls itself at its start or asserts itself, the main graph consumes a token, outputs can be read."""
    for graph in grammar.graphs.values():
        for number, node in graph.nodes.items():
            if node.output and "$" not in node.output and outputs.parse(node.output) is None:
                raise GrammarError(f"bad output code at node {number}: {node.output!r}")
            for text in (node.output or "", node.code):
                for fragment in expressions.FRAGMENT.findall(text):
                    try:
                        expressions.read(fragment)
                    except expressions.ExpressionError as reason:
                        raise GrammarError(f"node {number}: {reason}") from None
    asserted: set[str] = set()
    named: dict[str, set[str]] = {}
    for name, graph in grammar.graphs.items():
        named[name] = set()
        for node in graph.nodes.values():
            kind, code = kind_of(grammar, node)
            called = code if kind == "call" else code[1:].strip() if kind in ASSERTIONS and code.startswith(":") else None
            if called is not None:
                if called not in grammar.graphs:
                    raise UnknownGraphError(called)
                named[name].add(called)
                if kind != "call":
                    asserted.add(f"{name}\0{called}")
            if any(c not in graph.nodes for c in node.children):
                raise GrammarError("a child that does not exist")
    for pair in asserted:
        name, called = pair.split("\0")
        seen, todo = set(), [called]
        while todo:
            if (at := todo.pop()) not in seen:
                seen.add(at)
                todo += named[at]
        if name in seen:
            raise LeftRecursionError(f"{name} asserts a graph that leads back to it")
    empty: set[str] = set()

    def free(graph: Graph, number: int) -> bool:
        kind, code = kind_of(grammar, graph.nodes[number])
        return kind == "empty" or kind in ASSERTIONS or kind == "call" and code in empty

    grown = True
    while grown:
        grown = False
        for name, graph in grammar.graphs.items():
            reached, todo = set(), [graph.start]
            while todo:
                number = todo.pop()
                if number not in reached and (free(graph, number) or number == graph.end):
                    reached.add(number)
                    todo += graph.nodes[number].children
            if graph.end in reached and name not in empty:
                empty.add(name)
                grown = True
    for graph in grammar.graphs.values():
        for first in graph.nodes:
            seen, todo = set(), [first] if free(graph, first) else []
            while todo:
                for child in graph.nodes[todo.pop()].children:
                    if child == first:
                        raise InfiniteLoopError(f"node {first}")
                    if child not in seen and free(graph, child):
                        seen.add(child)
                        todo.append(child)
    # The graphs that each graph calls before a token.
    first: dict[str, set[str]] = {}
    for name, graph in grammar.graphs.items():
        called, seen, todo = set(), set(), [graph.start]
        while todo:
            number = todo.pop()
            if number in seen:
                continue
            seen.add(number)
            kind, code = kind_of(grammar, graph.nodes[number])
            if kind == "call" and number != graph.end:
                called.add(code)
            if free(graph, number):
                todo += graph.nodes[number].children
        first[name] = called
    for name in first:
        seen, todo = set(), list(first[name])
        while todo:
            called = todo.pop()
            if called == name:
                raise LeftRecursionError(name)
            if called not in seen:
                seen.add(called)
                todo += first[called]
    if grammar.main in empty:
        raise EmptyMatchError(grammar.main)


def _by_value(clauses: list[Clause], name: str) -> Callable[[Column], Column] | None:
    """A token's symbol as a case by the value of its one attribute, where the clauses ask for nothing but fixed values of it: no clause is tested at a token then."""
    terms = [t for c in clauses if not c.span for t in c.terms]
    values = sorted({t.value for t in terms if t.attribute == name})
    if not values or any(pattern_of(p) for t in terms for p in (t.attribute, t.value)):
        return None
    symbol = lambda own: F.lit(chr(FIRST_SYMBOL + sum(1 << k for k, c in enumerate(clauses) if not c.span and test_of(c)(own))))

    def case(value: Column) -> Column:
        found = F.when(value == values[0], symbol({name: values[0]}))
        for v in values[1:]:
            found = found.when(value == v, symbol({name: v}))
        # No other value fits a term, and a missing one neither.
        return found.otherwise(symbol({}))

    return case


def symbols(clauses: list[Clause], tokens: str = "features", of: Callable[[Column], dict[str, Column]] | None = None) -> Column:
    """A sentence's symbols: for each token the character of its truth vector.

    Tokens are feature maps, or any values from which ``of`` makes the attributes' columns; no map is built then.
    """
    alphabet = F.lit("".join(chr(FIRST_SYMBOL + k) for k in range(1 << len(clauses))))

    def symbol(token: Column | dict[str, Column]) -> Column:
        bits = F.lit(0)
        for k, clause in enumerate(clauses):
            # A clause of spans holds of no token.
            bits = bits if clause.span else bits + F.when(clause_column(clause, token), 1 << k).otherwise(0)
        return F.substr(alphabet, bits + 1, F.lit(1))

    if of is None:
        return F.array_join(F.transform(tokens, symbol), "")
    named = {t.attribute for c in clauses for t in c.terms}
    names = [n for n in of(F.lit("")) if n in named or any(a.startswith("/") for a in named)]
    if not names:
        return F.array_join(F.transform(tokens, lambda _: symbol({})), "")
    if len(names) == 1 and (case := _by_value(clauses, names[0])):
        return F.array_join(F.transform(F.transform(tokens, lambda w: of(w)[names[0]]), case), "")
    # Each attribute is computed once a token, whatever the number of clauses.
    opened = F.transform(tokens, lambda w: F.struct(*(of(w)[n].alias(n) for n in names)))
    return F.array_join(F.transform(opened, lambda t: symbol({n: t[n] for n in names})), "")


def _class(grammar: Grammar, code: str, clauses: list[Clause]) -> str:
    bits = [clauses.index(c) for c in parse_clauses(code)]
    held = [chr(FIRST_SYMBOL + v) for v in range(1 << len(clauses)) if any(v >> b & 1 for b in bits)]
    return f"[{''.join(held)}]"


def to_regex(grammar: Grammar, clauses: list[Clause], most: int = 200_000) -> str | None:
    """The regular expression over symbols, or None if the grammar needs the matcher."""

    def of(name: str, calls: tuple[str, ...]) -> str | None:
        if name in calls:
            return None
        graph, held = grammar.graphs[name], {}

        def rest(number: int, path: tuple[int, ...]) -> str | None:
            if number == graph.end:
                return ""
            if number in path:
                return None
            if number in held:
                return held[number]
            node = graph.nodes[number]
            kind, code = kind_of(grammar, node)
            inner = code[1:].strip() if kind in ASSERTIONS and code.startswith(":") else code if kind == "call" else None
            if kind in CROSS or inner is not None and kind in ("?<=", "?<!"):
                return None
            own = "" if kind == "empty" else _class(grammar, code, clauses) if inner is None else of(inner, (*calls, name))
            if own is None:
                return None
            if kind in LOOK:
                own = f"{LOOK[kind]}{own})"
            children = list(node.children)
            if number in children:
                # A loop at one node: greedy where it comes first, reluctant where it comes last.
                k = children.index(number)
                if 0 < k < len(children) - 1:
                    return None
                own = f"(?:{own})+" + ("?" if k else "")
                children.remove(number)
            tails = [rest(c, (*path, number)) for c in children]
            if any(t is None for t in tails) or not tails:
                return None
            out = own + (tails[0] if len(tails) == 1 else f"(?:{'|'.join(tails)})")
            if len(out) > most:
                return None
            held[number] = out
            return out

        return rest(graph.start, ())

    return of(grammar.main, ()) if len(clauses) <= MOST_CLAUSES and not grammar.scripted and not any(c.span for c in clauses) else None


# --- matching --------------------------------------------------------------------------------


def match(
    sentences: DataFrame, grammar: Grammar, features: str = "features", limit: int = 0, force_matcher: bool = False,
    of: Callable[[Column], dict[str, Column]] | None = None, keep: tuple[str, ...] = (), anchor: str | None = None, spans: str | None = None, traced: bool = False,
) -> DataFrame:
    """``doc_id, sid, start, len``: the leftmost non-overlapping matches of each sentence.

    ``sentences`` holds one row a sentence with an array of feature maps (or of values that ``of`` makes attributes from), so there is no
    shuffle. ``limit`` bounds the tokens of a match (0: none); ``keep`` names columns of the sentence that stay beside each match. With ``anchor``, a column
    of token numbers, only the match that starts at that token is asked for. A start counts once whatever its paths; the symbols are computed once a sentence.
    ``spans`` names a column of spans (``with_spans``): a clause ``<Name ...>`` then consumes the longest such span that starts at the token.
    Assertions at a token outside the sentence hold only if negative; in asserted graphs variables are those that the sentence starts with. Grammars with
    guards, call arguments or ``init`` also return ``variables``, as they are at the end of each match.

    With ``traced`` each match also returns ``path``, the nodes that its path entered, and ``written``, the spans that the outputs on it write, with their
    faults. Paths are followed in Python, but where the grammar is a regular expression only the sentences in which it matches get there, as strings of symbols.
    """
    check(grammar)
    clauses = clauses_of(grammar)
    pattern = None if limit or force_matcher else to_regex(grammar, clauses)
    if pattern is None or traced:
        return _match_each(sentences, grammar, clauses, features, limit, of, keep, anchor, spans, traced, pattern)
    sym = sentences.select("doc_id", "sid", *keep, *([F.col(anchor).alias("at_token")] if anchor else []), symbols(clauses, features, of).alias("sym"))
    return tiled(sym, pattern, keep, "at_token" if anchor else None)


def cuts(
    sentences: DataFrame, grammar: Grammar, features: str = "features", of: Callable[[Column], dict[str, Column]] | None = None, keep: tuple[str, ...] = (),
) -> DataFrame:
    """``doc_id, sid, *keep, cuts``: what ``match`` finds, left in the sentence's own row as the numbers of tokens before, in, between and after the matches, by turns.

    Only for grammars that are one regular expression.
    """
    check(grammar)
    clauses = clauses_of(grammar)
    if (pattern := to_regex(grammar, clauses)) is None:
        raise GrammarError("matches are cut in their sentence's row only where the grammar is one regular expression")
    sym = sentences.select("doc_id", "sid", *keep, symbols(clauses, features, of).alias("sym"))
    return sym.select("doc_id", "sid", *keep, F.transform(_parts(pattern), F.length).alias("cuts"))


def _parts(pattern: str) -> Column:
    """The column ``sym`` cut around its matches, which one replacement marks: every second part between marks is one."""
    return F.split(F.regexp_replace("sym", f"(?:{pattern})", f"{MARK}$0{MARK}"), MARK)


def tiled(sym: DataFrame, pattern: str, keep: tuple[str, ...] = (), anchor: str | None = None) -> DataFrame:
    """Matches from ``doc_id, sid, sym``: one replacement marks them, every second part between marks is one, and the lengths before it add up to its start."""
    if anchor:
        # The tokens before the anchor are matched one by one, so that look-behinds still see them.
        head = F.get(F.regexp_extract_all("sym", F.concat(F.lit("\\A(?s:.{"), F.col(anchor), F.lit("})((?:" + pattern + "))")), F.lit(1)), F.lit(0))
        found = sym.where(F.col(anchor) < F.length("sym")).select("doc_id", "sid", *keep, F.col(anchor).cast("int").alias("start"), F.length(head).alias("len"))
        return found.where("len > 0")
    state = F.struct(F.lit(0).alias("k"), F.lit(0).alias("at"), F.array().cast("array<struct<start:int,len:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        found = F.array_append(acc["out"], F.struct(acc["at"].alias("start"), F.length(x).alias("len")))
        return F.struct((acc["k"] + 1).alias("k"), (acc["at"] + F.length(x)).alias("at"), F.when(acc["k"] % 2 == 1, found).otherwise(acc["out"]).alias("out"))

    cut = sym.select("doc_id", "sid", *keep, _parts(pattern).alias("parts"))
    found = opened_rows(cut, ("doc_id", "sid", *keep), F.aggregate("parts", state, step)["out"], "m")
    return found.select("doc_id", "sid", *keep, "m.start", "m.len")


def with_spans(sentences: DataFrame, spans: DataFrame) -> DataFrame:
    """Sentences with their ``spans`` as a column: an array of ``name, start, end, features``, empty where there are none."""
    has = F.col("features") if "features" in spans.columns else F.lit(None).cast("map<string,string>")
    one = F.struct(F.col("name"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), has.alias("features"))
    held = spans.groupBy("doc_id", "sid").agg(F.collect_list(one).alias("spans"))
    kind = "array<struct<name:string,start:int,end:int,features:map<string,string>>>"
    return sentences.join(held, ["doc_id", "sid"], "left").withColumn("spans", F.coalesce("spans", F.array().cast(kind)))


def outputs_of(grammar: Grammar) -> dict[tuple[str, int], str]:
    return {(name, k): n.output for name, g in grammar.graphs.items() for k, n in g.nodes.items() if n.output}


def matcher(grammar: Grammar, clauses: list[Clause], traced: bool = False) -> Callable[..., tuple[int, dict, tuple | None]]:
    """What finds the end of the first path from a token of a sentence: backtracking over an explicit stack.

    A sentence is held as its tokens' truth vectors, the lengths of the spans that start and that end at each token by clause, what is known of its assertions, its tokens' attributes, and
    the variables it starts with.
    """
    parts = {name: {k: kind_of(grammar, n) for k, n in g.nodes.items()} for name, g in grammar.graphs.items()}
    written = outputs_of(grammar)
    guards = {(name, k): n.guard for name, g in grammar.graphs.items() for k, n in g.nodes.items() if n.guard}
    given = {
        (name, k): dict(tuple(map(str.strip, a.split("=", 1))) for a in found[1].split(",") if a.strip())
        for name, g in grammar.graphs.items() for k, n in g.nodes.items() if (found := _ARGUMENTS.match(n.code))
    }
    bits = {code: [clauses.index(c) for c in parse_clauses(code)] for g in parts.values() for kind, code in g.values() if kind not in ("empty", "call") and not code.startswith(":") and "$" not in code}
    dynamic: dict[str, list[Callable[[dict], bool]]] = {}
    openings: dict[str, tuple[set[int] | None, bool]] = {}

    def firsts(graph: str) -> tuple[set[int] | None, bool]:
        if graph not in openings:
            openings[graph] = first_bits(grammar, graph, clauses)
        return openings[graph]

    def told(code: str, own: dict) -> list[Callable[[dict], bool]]:
        """The tests of a condition whose fragments the path's variables fill; one that is no condition then holds of nothing."""
        text = expressions.filled(code, own)
        if text not in dynamic:
            try:
                dynamic[text] = [test_of(c) for c in parse_clauses(text)]
            except ValueError:
                dynamic[text] = []
        return dynamic[text]

    # By direction: where a graph is entered and left, the node without a code, and what follows each node.
    plan: dict[bool, dict] = {False: {}, True: {}}
    for name, g in grammar.graphs.items():
        before = {k: tuple(p for p, n in g.nodes.items() if k in n.children) for k in g.nodes}
        plan[False][name] = (g.start, g.end, g.end, {k: (*parts[name][k], tuple(n.children)) for k, n in g.nodes.items()})
        plan[True][name] = (g.end, g.start, g.end, {k: (*parts[name][k], before[k]) for k in g.nodes})

    def consumed(held: tuple, code: str, k: int, back: bool, own: dict) -> int:
        """How many tokens the first clause that holds takes from the boundary ``k`` on, or before it; 0 if none holds."""
        truth, by_start, by_end = held[:3]
        at = k - 1 if back else k
        if not 0 <= at < len(truth):
            return 0
        if "$" in code:
            return int(any(test(held[4][at]) for test in told(code, {**own, "token": held[4][at]})))
        return next((n for b in bits[code] if (n := int(truth[at][b]) or (by_end if back else by_start).get((b, at), 0))), 0)

    def asserted(held: tuple, kind: str, code: str, k: int) -> bool:
        truth, known, back, negative = held[0], held[3], "<" in kind, "!" in kind
        if not 0 <= (k - 1 if back else k) < len(truth):
            return negative
        key = (kind, code) if kind in CROSS else (kind, code, k)
        if key not in known:
            places = range(len(truth)) if kind in CROSS else (k,)
            bits_of, must = firsts(code[1:].strip()) if kind in CROSS and code.startswith(":") else (None, False)
            if bits_of is not None and must:
                places = [p for p in places if any(truth[p][b] or (b, p) in held[1] for b in bits_of)]
            if code.startswith(":"):
                found = any(True for p in places for _ in accepted(held, code[1:].strip(), p, len(truth), back))
            else:
                found = any(consumed(held, code, p, back, held[5]) for p in places)
            known[key] = found != negative
        return known[key]

    def accepted(held: tuple, graph: str, at: int, most: int, back: bool = False) -> Iterator[tuple[int, dict, tuple | None]]:
        """The boundaries at which paths from ``at`` end, with the variables there and the path's trail, in the order of priority.

        The stack holds what is still to be tried: a graph, a node, a boundary, the calls to return to as linked tuples, whether the node is passed,
        the variables, and the trail of entries and exits as linked tuples. No path changes these in place, so that turning back restores them.
        """
        todo = [(graph, plan[back][graph][0], at, None, False, held[5], None)]
        while todo:
            name, number, k, calls, passed, own, trail = todo.pop()
            _, last, bare, nodes = plan[back][name]
            kind, code, after = nodes[number]
            if not passed and number != bare:
                size = 0
                if kind == "token":
                    size = consumed(held, code, k, back, own)
                    if not size or not back and k + size > most:
                        continue
                elif kind in ASSERTIONS and not asserted(held, kind, code, k):
                    continue
                if (name, number) in guards:
                    said = guards[name, number](held[4], k - 1 if back else k, dict(own))
                    if said is None or said is False:
                        continue
                    own = said if isinstance(said, dict) else own
                if traced:
                    trail = (trail, True, name, number, k, own)
                if kind == "call":
                    more = given.get((name, number), {})
                    todo.append((code, plan[back][code][0], k, (name, number, calls, {a: own.get(a) for a in more}), False, {**own, **more}, trail))
                    continue
                k += -size if back else size
            elif traced and not passed:
                trail = (trail, True, name, number, k, own)
            if traced and (name, number) in written:
                trail = (trail, False, name, number, k, own)
            further = [] if number == last and not back else [(name, c, k, calls, False, own, trail) for c in reversed(after)]
            todo += further
            # Left, or a node that leads nowhere, which accepts in the outermost graph.
            if number == last or not further and calls is None and not back:
                if calls is None:
                    yield k, own, trail
                else:
                    # Arguments end with their call.
                    rest = own if not calls[3] else {a: v for a, v in {**own, **calls[3]}.items() if v is not None}
                    todo.append((calls[0], calls[1], k, calls[2], True, rest, trail))

    def first_end(held: tuple, at: int, most: int, graph: str | None = None) -> tuple[int, dict, tuple | None]:
        """Where the first path of a graph (the main one) ends that consumes a token; ``at`` without one."""
        return next((found for found in accepted(held, graph or grammar.main, at, most) if found[0] > at), (at, {}, None))

    return first_end


def _match_each(
    sentences: DataFrame, grammar: Grammar, clauses: list[Clause], features: str, limit: int, of, keep: tuple[str, ...], anchor: str | None, spans: str | None,
    traced: bool = False, pattern: str | None = None,
) -> DataFrame:
    """The matcher for what is no regular expression: backtracking over an explicit stack, a sentence at a time."""
    of_spans = [b for b, c in enumerate(clauses) if c.span]
    if of_spans and spans is None:
        raise GrammarError("span clauses need a column of spans")
    names = None if of is None else list(of(F.lit("")))
    opened = F.col(features) if of is None else F.transform(features, lambda w: F.struct(*(of(w)[n].alias(n) for n in names)))
    truth = F.transform(opened, lambda t: F.array(*(F.lit(False) if c.span else clause_column(c, t if of is None else {n: t[n] for n in names}) for c in clauses)))

    def held_by(b: int) -> Column:
        wanted = lambda x: (x["name"] == clauses[b].span) & clause_column(clauses[b], x["features"])
        return F.transform(F.filter(spans, wanted), lambda x: F.array(F.lit(b), x["start"].cast("int"), x["end"].cast("int")))

    covered = F.flatten(F.array(*map(held_by, of_spans))) if of_spans else F.array().cast("array<array<int>>")
    token = (F.col(anchor) if anchor else F.lit(None)).cast("int")
    shown = F.transform(opened, lambda t: F.to_json(t)) if grammar.scripted else F.array().cast("array<string>")
    short = len(clauses) <= MOST_CLAUSES
    bits, _ = first_bits(grammar, grammar.main, clauses)
    if short:
        # The symbols are opened as an array of one, so that the filter on them does not compute them again.
        more_columns = (covered.alias("covered"), shown.alias("shown"), token.alias("at_token"))
        whole = opened_rows(sentences, ("doc_id", "sid", *keep, *more_columns), F.array(symbols(clauses, features, of)), "truth")
        first = pattern or _held_class(bits, clauses) if bits is not None and not anchor else None
        if first is not None:
            # Only sentences in which a match may start get to Python.
            whole = whole.where(F.col("truth").rlike(first) | (F.size("covered") > 0) if of_spans else F.col("truth").rlike(first))
        vectors = whole.select("doc_id", "sid", *keep, "truth", "covered", "shown", "at_token")
    else:
        vectors = sentences.select("doc_id", "sid", *keep, truth.alias("truth"), covered.alias("covered"), shown.alias("shown"), token.alias("at_token"))
    first_end = matcher(grammar, clauses, traced)
    kept = [sentences.schema[c] for c in keep]
    scripted, init = grammar.scripted, grammar.init
    more = [StructField("variables", MapType(StringType(), StringType()))] if scripted else []
    more += [StructField("path", outputs.PATH), StructField("written", outputs.WRITTEN)] if traced else []
    written = outputs_of(grammar)
    tables = [tuple(v >> b & 1 for b in range(len(clauses))) for v in range(1 << len(clauses))] if short else []
    schema = StructType([StructField("doc_id", LongType()), StructField("sid", LongType()), *kept, StructField("start", IntegerType()), StructField("len", IntegerType()), *more])
    # Without assertions and variables a path depends on the symbols that it takes alone, so equal matches share one.
    alone = pattern is not None and not scripted and not any(kind_of(grammar, n)[0] in ASSERTIONS or "$" in (n.output or "") for g in grammar.graphs.values() for n in g.nodes.values())

    arrow = to_arrow_schema(schema)
    places = [len(kept) + 2 + k for k in range(4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expression = re.compile(pattern) if pattern is not None else None
        first_class = re.compile(_held_class(bits, clauses)) if bits is not None and short else None
        known: dict[str, tuple] = {}
        for batch in batches:
            rows, said, entries, entry_of = [], [], [], []
            numbers: dict[str, int] = {}
            n = batch.num_rows
            truths = batch.column(places[0]).to_pylist()
            covers = batch.column(places[1]).to_pylist() if of_spans else [()] * n
            shows = batch.column(places[2]).to_pylist() if scripted else [()] * n
            asked = batch.column(places[3]).to_pylist() if anchor else [None] * n
            for i, (truth, cover, show, token) in enumerate(zip(truths, covers, shows, asked, strict=True)):
                found = None
                if expression is not None and token is None:
                    # Paths are followed only from where the expression matches.
                    found = {m.start(): m[0] for m in expression.finditer(truth)}
                    if traced and alone and all(m in known for m in found.values()):
                        for at, m in found.items():
                            if m not in numbers:
                                numbers[m] = len(entries)
                                entries.append(known[m])
                            rows.append((i, at, len(m)))
                            entry_of.append(numbers[m])
                        continue
                by_start, by_end = {}, {}
                for b, start, end in cover:
                    by_start[b, start] = max(by_start.get((b, start), 0), end - start + 1)
                    by_end[b, end] = max(by_end.get((b, end), 0), end - start + 1)
                starts = found
                if starts is None and first_class is not None:
                    starts = {m.start() for m in first_class.finditer(truth)} | {at for b, at in by_start if b in bits}
                if starts is not None and not starts and token is None:
                    continue
                if short:
                    truth = [tables[ord(c) - FIRST_SYMBOL] for c in truth]
                sentence = [json.loads(t) if t else {} for t in show]
                held = (truth, by_start, by_end, {}, sentence, init(sentence) if init else {})
                anchored = token is not None
                at, past = (int(token), int(token) + 1) if anchored else (0, len(truth))
                while at < min(past, len(truth)):
                    if starts is not None and not anchored and at not in starts:
                        at += 1
                        continue
                    stop, variables, trail = first_end(held, at, at + limit if limit else len(truth))
                    if stop > at:
                        rows.append((i, at, stop - at))
                        if scripted:
                            said.append([(k, str(v)) for k, v in variables.items()])
                        if traced:
                            path, spans = outputs.replayed(trail, written)
                            moved = [{**s, "start": s["start"] if s["start"] is None else s["start"] - at, "end": s["end"] if s["end"] is None else s["end"] - at} for s in spans]
                            if alone and found is not None and len(found[at]) == stop - at:
                                if len(known) >= MOST_KNOWN:
                                    known.clear()
                                known[found[at]] = (path, moved)
                            entry_of.append(len(entries))
                            entries.append((path, moved))
                    at = max(stop, at + 1)
            if rows:
                at_row, at, size = (pa.array(c, pa.int32()) for c in zip(*rows, strict=True))
                columns = [batch.column(k).take(at_row) for k in range(2 + len(kept))] + [at, size]
                if scripted:
                    columns.append(pa.array(said, arrow.field("variables").type))
                if traced:
                    paths, spans = (pa.array([e[k] for e in entries], arrow.field(name).type).take(pa.array(entry_of, pa.int32())) for k, name in enumerate(("path", "written")))
                    columns += [paths, outputs.moved(spans, at)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return vectors.mapInArrow(run, schema)


def first_bits(grammar: Grammar, graph: str, clauses: list[Clause]) -> tuple[set[int] | None, bool]:
    """The clauses of which one holds for the first token that a path of a graph takes (None where that is only known along the path), and whether every path takes one."""
    found: set[int] = set()
    known, must = True, True
    seen, todo = set(), [(graph, grammar.graphs[graph].start)]
    while todo:
        if (at := todo.pop()) in seen:
            continue
        seen.add(at)
        name, number = at
        held = grammar.graphs[name]
        kind, code = kind_of(grammar, held.nodes[number])
        if kind == "token" and number != held.end:
            if "$" in code:
                known = False
            else:
                found |= {clauses.index(c) for c in parse_clauses(code)}
            continue
        if kind == "call" and number != held.end:
            todo.append((code, grammar.graphs[code].start))
        # A called graph may be left without a token.
        must = must and not (name == graph and number == held.end) and bool(held.nodes[number].children or name != graph)
        todo += [(name, c) for c in held.nodes[number].children]
    return (found if known else None), must


def _held_class(bits: set[int], clauses: list[Clause]) -> str:
    """The symbols for which one of the clauses holds."""
    held = [chr(FIRST_SYMBOL + v) for v in range(1 << len(clauses)) if any(v >> b & 1 for b in bits)]
    return f"[{''.join(held)}]" if held else r"(?!)"


#: An opening ``<Name +key="value" ...``, more ``+key="value"``, and the closing ``>`` of a span (output codes).
_OUTPUT = re.compile(r'^<(\w+)((?:\s*\+\w+="[^"]*")*)\s*>$')


def annotated(matches: DataFrame, code: str) -> DataFrame:
    """``doc_id, sid, span_id, name, start, end, features``: matches as spans, by output code ``<Name +key="value">``.

    Other columns of ``matches``, or else their variables, can be named in a value as ``$name$``.
    """
    found = _OUTPUT.match(code.strip())
    if not found:
        raise GrammarError(f"bad output code: {code!r}")
    pairs = re.findall(r'\+(\w+)="([^"]*)"', found[2])

    def value(text: str) -> Column:
        parts = re.split(r"\$(\w+)\$", text)
        named = lambda p: F.col(p).cast("string") if p in matches.columns else F.coalesce(F.try_element_at("variables", F.lit(p)), F.lit(""))
        return F.concat(*(named(p) if k % 2 else F.lit(p) for k, p in enumerate(parts)))

    entries = [c for k, v in pairs for c in (F.lit(k), value(v))]
    features = F.create_map(*entries) if entries else F.lit(None).cast("map<string,string>")
    return spans_from(matches, found[1], features)


def spans_from(matches: DataFrame, name: str, features: Column | None = None) -> DataFrame:
    """Matches as span annotations."""
    number = F.xxhash64("doc_id", "sid", "start", "len")
    more = [] if features is None else [features.alias("features")]
    return matches.select("doc_id", "sid", number.alias("span_id"), F.lit(name).alias("name"), "start", (F.col("start") + F.col("len") - 1).alias("end"), *more)
