"""Compiling queries: every node becomes a nullable DOUBLE column, null meaning no match.

Nodes are laid out in layers (leaves first, then the Bools over them), each layer one
projection, so a clause's score is computed once however often the tree above uses it.
Beside the score comes a plain predicate of what can be pushed down to the scan, because an optimizer can't see
through ``score IS NOT NULL``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.once import computed_once
from . import ast
from . import mapping as mp

_NUMERIC = (mp.INTEGER, mp.LONG, mp.DOUBLE)


def no_match() -> Column:
    return F.lit(None).cast("double")


# -- what a query needs -----------------------------------------------------------------------


def query_terms(q: ast.Query, root: bool = True) -> set[str]:
    """Terms whose frequency in the collection counts for the score. Excluding clauses have none."""
    if isinstance(q, (ast.Match, ast.Phrase)):
        return set(tx.tokenize(q.value))
    if isinstance(q, ast.MultiMatch):
        return set(tx.tokenize(q.query))
    if isinstance(q, ast.Term):
        return {q.value.lower()} if isinstance(q.value, str) and q.fuzziness is None else set()
    if isinstance(q, ast.Terms):
        return {v.lower() for v in q.values if isinstance(v, str)}
    if isinstance(q, ast.Prefix):
        return {q.value.lower()} if root else set()
    if isinstance(q, ast.Bool):
        return set().union(*(query_terms(c, False) for c in q.must + q.should + q.filter))
    return set()


def token_fields(q: ast.Query, mapping: mp.Mapping) -> set[str]:
    """Text fields whose tokens the query looks at."""
    if isinstance(q, ast.MultiMatch):
        names = {f for f, _ in q.fields}
    elif isinstance(q, ast.Bool):
        return set().union(*(token_fields(c, mapping) for c in ast.clauses(q)))
    elif isinstance(q, ast.Term) and q.fuzziness is not None:
        return set()
    else:
        names = {q.field} if isinstance(q, (ast.Term, ast.Terms, ast.Prefix, ast.Wildcard, ast.Match, ast.Phrase)) else set()
    return {f for f in names if mapping.get(f) == mp.KEYWORD}


def words_by_field(q: ast.Query, mapping: mp.Mapping) -> set[tuple[str, str]] | None:
    """(field, word) of all frequencies the query's score is made of; None if it needs more of a text than those."""
    text = lambda f: mapping.get(f) == mp.KEYWORD
    if isinstance(q, ast.Bool):
        parts = [words_by_field(c, mapping) for c in ast.clauses(q)]
        return None if any(p is None for p in parts) else set().union(*parts)
    if isinstance(q, ast.MultiMatch):
        words = tx.tokenize(q.query)
        # the last word of a phrase's beginning is one by which others begin
        return {(f, w) for f, _ in q.fields if text(f) for w in (words[:-1] if q.type == ast.PHRASE_PREFIX else words)}
    if isinstance(q, (ast.MatchAll, ast.Range)) or not text(getattr(q, "field", None)):
        return None if isinstance(q, ast.MoreLikeThis) else set()
    if isinstance(q, (ast.Match, ast.Phrase)):
        return {(q.field, w) for w in tx.tokenize(q.value)}
    if isinstance(q, ast.Term):
        return None if q.fuzziness is not None else {(q.field, q.value.lower())} if isinstance(q.value, str) else set()
    if isinstance(q, ast.Terms):
        return {(q.field, v.lower()) for v in q.values if isinstance(v, str)}
    return None


def placed_words(q: ast.Query, mapping: mp.Mapping) -> tuple[set[tuple[str, str]], set[tuple[str, str]]]:
    """(field, word) whose places in the text the query looks at, and (field, beginning) of which it needs the last place of a word that begins so."""
    if isinstance(q, ast.Bool):
        parts = [placed_words(c, mapping) for c in ast.clauses(q)]
        return set().union(*(p[0] for p in parts)), set().union(*(p[1] for p in parts))
    if isinstance(q, ast.Phrase) and mapping.get(q.field) == mp.KEYWORD:
        return {(q.field, w) for w in tx.tokenize(q.value)}, set()
    if isinstance(q, ast.MultiMatch) and q.type in (ast.PHRASE, ast.PHRASE_PREFIX) and len(words := tx.tokenize(q.query)) > 1:
        fields = [f for f, _ in q.fields if mapping.get(f) == mp.KEYWORD]
        whole = q.type == ast.PHRASE
        return {(f, w) for f in fields for w in (words if whole else words[:-1])}, set() if whole else {(f, words[-1]) for f in fields}
    return set(), set()


def needs_word(q: ast.Query, mapping: mp.Mapping) -> bool:
    """Every match holds at least one of the query's words."""
    if isinstance(q, ast.Bool):
        return any(needs_word(c, mapping) for c in q.must + q.filter) or _least(q) >= 1 and all(needs_word(c, mapping) for c in q.should)
    if isinstance(q, ast.MultiMatch):
        return True
    return isinstance(q, (ast.Match, ast.Phrase, ast.Term, ast.Terms)) and mapping.get(q.field) == mp.KEYWORD


def plain_fields(q: ast.Query, mapping: mp.Mapping) -> set[str]:
    """Fields whose values, and not words, the query looks at."""
    if isinstance(q, ast.Bool):
        return set().union(*(plain_fields(c, mapping) for c in ast.clauses(q)))
    name = getattr(q, "field", None)
    return {name} if name in mapping and mapping[name] != mp.KEYWORD else set()


# -- pushdown ---------------------------------------------------------------------------------


def pushable(q: ast.Query, mapping: mp.Mapping) -> Column | None:
    """A plain predicate that every match satisfies, or None."""
    if isinstance(q, (ast.Range, ast.Term, ast.Terms)) and mapping.get(q.field) not in (None, mp.KEYWORD, mp.OBJECT):
        return _plain(q, mapping)
    if isinstance(q, ast.Prefix) and mapping.get(q.field) == mp.KEYWORD:
        return F.col(f"`{q.field}`").startswith(q.value)
    if isinstance(q, ast.Bool):
        parts = [p for p in (pushable(c, mapping) for c in q.must + q.filter) if p is not None]
        if q.should and _least(q) >= 1:
            either = [pushable(c, mapping) for c in q.should]
            if all(p is not None for p in either):
                one = either[0]
                for p in either[1:]:
                    one = one | p
                parts.append(one)
        if parts:
            both = parts[0]
            for p in parts[1:]:
                both = both & p
            return both
    return None


def _plain(q: ast.Query, mapping: mp.Mapping) -> Column:
    if isinstance(q, ast.Range):
        return _range(q, mapping)
    values = q.values if isinstance(q, ast.Terms) else (q.value,)
    fits = [v for v in values if literal_fits(v, mapping[q.field])]
    if mapping[q.field] == mp.TIMESTAMP:
        instants = [mp.parse_rfc3339(v) for v in values]
        fits = [v for v in instants if v is not None]
    return F.col(f"`{q.field}`").isin(fits) if fits else F.lit(False)


def literal_fits(value: Any, kind: str) -> bool:
    """JSON equality tells 1 from 1.0 and from true."""
    if isinstance(value, bool):
        return kind == mp.BOOLEAN
    if isinstance(value, int):
        return kind in (mp.INTEGER, mp.LONG) or kind == mp.DOUBLE and not -(2**63) <= value < 2**63
    return isinstance(value, float) and kind == mp.DOUBLE


def _range(q: ast.Range, mapping: mp.Mapping) -> Column:
    """All given bounds hold; a bound of another kind than the field fails; without bounds any value matches."""
    kind, col = mapping[q.field], F.col(f"`{q.field}`")
    out = col.isNotNull()
    for name in ("gte", "gt", "lte", "lt"):
        bound = getattr(q, name)
        if bound is None:
            continue
        if kind in _NUMERIC and isinstance(bound, (int, float)) and not isinstance(bound, bool):
            bound = F.lit(bound)
        elif kind == mp.TIMESTAMP and (at := mp.parse_rfc3339(bound)) is not None:
            bound = F.lit(at.isoformat(" ")).cast("timestamp_ntz")
        else:
            return F.lit(False)
        out = out & {"gte": col >= bound, "gt": col > bound, "lte": col <= bound, "lt": col < bound}[name]
    return out


def _least(q: ast.Bool) -> int:
    if not q.should:
        return 0
    if q.minimum_should_match is not None:
        return q.minimum_should_match
    return 0 if q.must or q.filter else 1


# -- scores -----------------------------------------------------------------------------------


@dataclass
class Compiler:
    """Scores of one query. ``stats`` has ``idf(term)`` and ``average``.

    ``given`` names columns that hold frequencies ("tf", field, word) and lengths ("length", field)
    already; without it they are taken from the token columns.
    """

    mapping: mp.Mapping
    stats: Any
    given: dict[tuple, str] | None = None
    layers: list[dict[str, Column]] = field(default_factory=list)
    made: dict[tuple, str] = field(default_factory=dict)

    def score(self, df: DataFrame, q: ast.Query, name: str = "_score") -> DataFrame:
        """``df`` (with token columns) with the query's score."""
        self.layers, self.made = [{}], {}
        column, _ = self._node(q)
        before = df.columns
        for layer in self.layers:
            df = df.withColumns(layer)
        # a filter on the score must not copy all of these expressions below them
        return df.select(*[F.col(f"`{c}`") for c in before], computed_once(column).alias(name))

    def _keep(self, column: Column, layer: int) -> tuple[Column, int]:
        while len(self.layers) <= layer:
            self.layers.append({})
        name = f"_s{layer}_{len(self.layers[layer])}"
        self.layers[layer][name] = column
        return F.col(name), layer

    def _node(self, q: ast.Query) -> tuple[Column, int]:
        if not isinstance(q, ast.Bool):
            return self._keep(self._leaf(q), 1)
        must, should, required, excluded = ([self._node(c) for c in part] for part in (q.must, q.should, q.filter, q.must_not))
        layer = 1 + max([l for part in (must, should, required, excluded) for _, l in part], default=0)
        return self._keep(self._bool(q, *([c for c, _ in part] for part in (must, should, required, excluded))), layer)

    @staticmethod
    def _bool(q: ast.Bool, must: list, should: list, required: list, excluded: list) -> Column:
        """The mean of the matching scored clauses, 1 where there is none."""
        ok = F.lit(True)
        for c in must + required:
            ok = ok & c.isNotNull()
        for c in excluded:
            ok = ok & c.isNull()
        hits, total = F.lit(len(must)), F.lit(0.0)
        optional = F.lit(0)
        for c in must:
            total = total + F.coalesce(c, F.lit(0.0))
        for c in should:
            total = total + F.coalesce(c, F.lit(0.0))
            optional = optional + c.isNotNull().cast("int")
        hits = hits + optional
        ok = ok & (optional >= F.lit(_least(q)))
        return F.when(ok, F.when(hits > 0, total / hits).otherwise(F.lit(1.0)))

    def _leaf(self, q: ast.Query) -> Column:
        if isinstance(q, ast.MatchAll):
            return F.lit(1.0)
        if isinstance(q, ast.MoreLikeThis):  # only the whole query can be one, and it is rewritten before
            return no_match()
        if isinstance(q, ast.MultiMatch):
            return self._multi_match(q)
        kind = self.mapping.get(q.field)
        if kind is None:
            return no_match()
        if isinstance(q, ast.Range):
            return F.when(_range(q, self.mapping), F.lit(1.0)) if kind in (*_NUMERIC, mp.TIMESTAMP) else no_match()
        if isinstance(q, ast.Term):
            return self._term(q, kind)
        if isinstance(q, ast.Terms):
            return self._terms(q, kind)
        if kind != mp.KEYWORD:
            return no_match()
        return {ast.Prefix: self._prefix, ast.Wildcard: self._wildcard, ast.Match: self._match, ast.Phrase: self._phrase}[type(q)](q)

    # single terms

    def _tok(self, name: str) -> Column:
        return F.col(f"`_tok_{name}`")

    def _once(self, key: tuple, make) -> Column:
        """A column of the first layer, made once however many clauses use it."""
        if self.given is not None:
            return F.coalesce(F.col(f"`{self.given[key]}`"), F.lit(0))
        if key not in self.made:
            self.made[key] = f"_f{len(self.made)}"
            self.layers[0][self.made[key]] = make()
        return F.col(self.made[key])

    def _bm25(self, name: str, tf: Column, idf: float | Column) -> Column:
        length = self._once(("length", name), lambda: F.size(self._tok(name)))
        return tx.bm25(tf, idf, length, self.stats.average.get(name, 1.0))

    def _word(self, name: str, word: str) -> Column:
        """BM25 of a word in a field, null where it isn't there."""
        tf = self._once(("tf", name, word), lambda: tx.frequency(self._tok(name), word))
        return F.when(tf > 0, self._bm25(name, tf, self.stats.idf(word)))

    def _equal(self, name: str, value: Any, kind: str) -> Column:
        col = F.col(f"`{name}`")
        if kind == mp.TIMESTAMP:
            at = mp.parse_rfc3339(value)
            return F.lit(False) if at is None else col == F.lit(at.isoformat(" ")).cast("timestamp_ntz")
        if kind == mp.OBJECT:
            return F.to_json(F.try_parse_json(col)) == F.to_json(F.parse_json(F.lit(mp.canonical(value)))) if isinstance(value, dict) else F.lit(False)
        return col == F.lit(value) if literal_fits(value, kind) else F.lit(False)

    def _term(self, q: ast.Term, kind: str) -> Column:
        if q.fuzziness is not None:
            return self._fuzzy(q, kind)
        if kind != mp.KEYWORD:
            return F.when(self._equal(q.field, q.value, kind), F.lit(1.0))
        return self._word(q.field, q.value.lower()) * F.lit(q.boost) if isinstance(q.value, str) else no_match()

    def _fuzzy(self, q: ast.Term, kind: str) -> Column:
        """The whole value within so many edits, case counting; by default up to 2 edits by the query's length in bytes."""
        if kind != mp.KEYWORD or not isinstance(q.value, str):
            return no_match()
        size = len(q.value.encode())
        edits = (0 if size < 3 else 1 if size < 6 else 2) if q.fuzziness == "auto" else int(q.fuzziness)
        col = F.col(f"`{q.field}`")
        close = col == q.value if edits == 0 else F.levenshtein(col, F.lit(q.value), edits) >= 0
        return F.when(close, F.lit(1.0))

    def _terms(self, q: ast.Terms, kind: str) -> Column:
        """The best of the values; a best score of 0 (a word in more than half of the documents) is no match."""
        if kind != mp.KEYWORD:
            hits = [self._equal(q.field, v, kind) for v in q.values]
            any_hit = F.lit(False)
            for h in hits:
                any_hit = any_hit | h
            return F.when(any_hit, F.lit(1.0))
        words = sorted({v.lower() for v in q.values if isinstance(v, str)})
        if not words:
            return no_match()
        scores = [F.coalesce(self._word(q.field, w), F.lit(0.0)) for w in words]
        best = F.greatest(*scores) if len(scores) > 1 else scores[0]
        return F.when(best > 0, best)

    def _each_word(self, name: str, chosen: Column, idf_of) -> Column:
        """Sum over the occurrences of the chosen tokens of their BM25."""
        one = lambda acc, w: acc + self._occurrences(chosen, w) * self._bm25(name, self._occurrences(chosen, w), idf_of(w))
        return F.aggregate(F.array_distinct(chosen), F.lit(0.0), one)

    @staticmethod
    def _occurrences(tok: Column, word: Column) -> Column:
        return F.size(F.filter(tok, lambda x: x == word))

    def _prefix(self, q: ast.Prefix) -> Column:
        """The whole value begins with the prefix as written; scored over the tokens that begin with it."""
        low = q.value.lower()
        chosen = F.filter(self._tok(q.field), lambda w: w.startswith(low))
        own = self.stats.idf(low)
        total = self._each_word(q.field, chosen, lambda w: F.when(w == low, F.lit(own)).otherwise(F.lit(1.0)))
        return F.when(F.col(f"`{q.field}`").startswith(q.value) & (F.size(chosen) > 0), total)

    def _wildcard(self, q: ast.Wildcard) -> Column:
        """The whole value fits the pattern; scored over the tokens that fit it by themselves."""
        pattern = tx.glob_pattern(q.value)
        chosen = F.filter(self._tok(q.field), lambda w: w.rlike(pattern))
        total = F.when(F.col(f"`{q.field}`").rlike(pattern), self._each_word(q.field, chosen, lambda _: F.lit(1.0)))
        return F.when(total > 0, total)

    # texts

    def _any_word(self, name: str, words: list[str]) -> Column:
        """Sum over the words (repeated ones again), null where none is there."""
        if not words:
            return no_match()
        scores = {w: self._word(name, w) for w in words}
        total, some = F.lit(0.0), F.lit(False)
        for w in words:
            total = total + F.coalesce(scores[w], F.lit(0.0))
        for s in scores.values():
            some = some | s.isNotNull()
        return F.when(some, total)

    def _match(self, q: ast.Match) -> Column:
        return self._any_word(q.field, tx.tokenize(q.value))

    def _phrase(self, q: ast.Phrase) -> Column:
        """The words in order, each anywhere after the one before; wide gaps cost.

        From each place of the first word the others are taken at their next place. The gap is
        the largest distance in bytes between starts, as if single spaces parted the tokens; the
        start with the least counts. ``slop`` 0 asks for adjacent words instead.
        """
        words, tok = tx.tokenize(q.value), self._tok(q.field)
        if len(words) < 2:
            return no_match()
        total = F.lit(0.0)
        there = F.lit(True)
        for w in words:
            total = total + F.coalesce(self._word(q.field, w), F.lit(0.0))
        if self.given is not None:
            if q.slop == 0:
                return F.when(self._adjacent_starts(q.field, words).isNotNull(), total)
            return self._by_gap(self._placed_gap(q.field, words), total)
        for w in sorted(set(words)):
            there = there & F.array_contains(tok, w)
        if q.slop == 0:
            return F.when(self._adjacent(tok, words), total)

        def follow(start: Column) -> Column:
            state = F.struct(start.alias("at"), F.lit(0).alias("gap"))

            def step(acc: Column, word: Column) -> Column:
                ahead = F.array_position(F.slice(tok, acc["at"] + 1, F.size(tok)), word).cast("int")
                gap = F.octet_length(F.array_join(F.slice(tok, acc["at"], ahead), " ")) + 1
                return F.when(
                    acc["at"].isNotNull() & (ahead > 0), F.struct((acc["at"] + ahead).alias("at"), F.greatest(acc["gap"], gap).alias("gap"))
                ).otherwise(F.struct(F.lit(None).cast("int").alias("at"), F.lit(0).alias("gap")))

            return F.aggregate(F.array(*[F.lit(w) for w in words[1:]]), state, step)

        starts = F.filter(F.sequence(F.lit(1), F.size(tok)), lambda i: F.get(tok, i - 1) == words[0])
        ends = F.filter(F.transform(starts, follow), lambda s: s["at"].isNotNull())
        return F.when(there, self._by_gap(F.array_min(F.transform(ends, lambda s: s["gap"])), total))

    @staticmethod
    def _by_gap(gap: Column, total: Column) -> Column:
        cost = F.when(gap > tx.FREE_GAP, F.lit(1.0) + F.lit(tx.GAP_COST) * gap).otherwise(F.lit(1.0))
        return F.when(gap.isNotNull(), total / cost)

    # the same by the places of the words, as posting lists have them

    def _places(self, name: str, word: str) -> Column:
        return F.coalesce(F.col(f"`{self.given[('places', name, word)]}`"), F.expr("cast(array() as array<struct<at:int,byte:int>>)"))

    def _placed_gap(self, name: str, words: list[str]) -> Column:
        """The least of the largest distances from each place of the first word on, null where none leads to the last word."""

        def follow(start: Column) -> Column:
            def step(acc: Column, places: Column) -> Column:
                ahead = F.get(F.filter(places, lambda p: p["at"] > acc["at"]), F.lit(0))
                return F.struct(ahead["at"].alias("at"), ahead["byte"].alias("byte"), F.greatest(acc["gap"], ahead["byte"] - acc["byte"]).alias("gap"))

            return F.aggregate(F.array(*[self._places(name, w) for w in words[1:]]), F.struct(start["at"].alias("at"), start["byte"].alias("byte"), F.lit(0).alias("gap")), step)

        ends = F.filter(F.transform(self._places(name, words[0]), follow), lambda s: s["at"].isNotNull())
        return F.array_min(F.transform(ends, lambda s: s["gap"]))

    def _adjacent_starts(self, name: str, words: list[str]) -> Column:
        """The first place where the words follow each other, null where they don't."""
        others = [F.transform(self._places(name, w), lambda p: p["at"]) for w in words[1:]]

        def whole(s: Column) -> Column:
            ok = F.lit(True)
            for k, places in enumerate(others, 1):
                ok = ok & F.array_contains(places, s["at"] + F.lit(k))
            return ok

        return F.array_min(F.transform(F.filter(self._places(name, words[0]), whole), lambda s: s["at"]))

    @staticmethod
    def _adjacent(tok: Column, words: list[str]) -> Column:
        return F.coalesce(F.contains(tx.joined(tok), F.lit(" " + " ".join(words) + " ")), F.lit(False))

    def _multi_match(self, q: ast.MultiMatch) -> Column:
        words = tx.tokenize(q.query)
        fields = [(f, w) for f, w in q.fields if self.mapping.get(f) == mp.KEYWORD]
        if not fields or not words:
            return no_match()
        if q.type in (ast.PHRASE, ast.PHRASE_PREFIX):
            if len(words) < 2:
                return no_match()
            weight = sum(self.stats.idf(w) for w in words)
            scores = []
            for name, w in fields:
                tok = self._tok(name)
                if self.given is not None:
                    whole = q.type == ast.PHRASE
                    start = self._adjacent_starts(name, words if whole else words[:-1])
                    hit = start.isNotNull() if whole else F.coalesce(F.col(f"`{self.given[('last', name, words[-1])]}`") > start + F.lit(len(words) - 2), F.lit(False))
                elif q.type == ast.PHRASE:
                    hit = self._adjacent(tok, words)
                else:
                    # the last word begins some later token, adjacent or not
                    lead = " " + " ".join(words[:-1]) + " "
                    text = tx.joined(tok)
                    at = F.instr(text, lead)
                    hit = (at > 0) & F.contains(F.substr(text, at + F.lit(len(lead) - 1)), F.lit(" " + words[-1]))
                scores.append(F.when(hit, F.lit(weight * w)))
            return F.greatest(*scores) if len(scores) > 1 else scores[0]
        scores = [self._any_word(f, words) * F.lit(w) for f, w in fields]
        total = F.lit(0.0)
        for s in scores:
            total = total + F.coalesce(s, F.lit(0.0))
        best = F.greatest(*scores) if len(scores) > 1 else scores[0]
        if q.type == ast.MOST_FIELDS:
            return F.when(best.isNotNull(), total)
        return best + F.lit(q.tie_breaker) * (total - best)
