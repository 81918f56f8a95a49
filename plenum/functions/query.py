"""The query grammar: phrases, AND / OR / NOT, exclusion, expansion; compiled to a predicate over token arrays.

A query is one short string, so all of this runs on the driver.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plenum.functions import constants as C

# The patterns and words of the query grammar.
_PHRASE = re.compile(r'"([^"]+)"')
_AND = re.compile(r"\bAND\b", re.IGNORECASE)
_OR = re.compile(r"\bOR\b|\bאו\b", re.IGNORECASE)
_NOT = {"NOT", "לא"}
MAX_VARIANTS = 5


@dataclass
class Parsed:
    phrases: list[str] = field(default_factory=list)
    terms: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    operator: str = "and"

    @property
    def embedding_text(self) -> str:
        return " ".join(self.phrases + self.terms)

    @property
    def has_operators(self) -> bool:
        """AND alone is no operator: it is what terms are joined by anyway."""
        return bool(self.phrases or self.excluded) or self.operator == "or"


def parse(query: str) -> Parsed:
    out = Parsed(phrases=_PHRASE.findall(query))
    rest = _AND.sub(" ", _PHRASE.sub("", query))
    out.operator = "or" if _OR.search(rest) else "and"
    queue = _OR.sub(" ", rest).split()[::-1]
    while queue:
        token = queue.pop()
        if token.upper() in _NOT and queue:
            out.excluded.append(queue.pop())
        elif token[0] == "-" and len(token) > 1:
            out.excluded.append(token[1:])
        else:
            out.terms.append(token)
    return out


def is_hebrew(word: str) -> bool:
    return any("֐" <= c <= "׿" for c in word)


def _without_prefix(word: str) -> str:
    return word[1:] if word[:1] in C.PREFIXES and word else word


def morphology(text: str) -> set[str]:
    """Forms of the Hebrew words of three letters or more: without prefix, without each suffix, with every suffix, and
    known variants."""
    found: set[str] = set()
    for word in text.split():
        if len(word) < 3 or not is_hebrew(word):
            continue
        bases = {word, _without_prefix(word)}
        stems = {b[: -len(s)] for b in bases for s in C.SUFFIXES if b.endswith(s) and len(b) - len(s) >= 2}
        forms = stems | {stem + s for stem in stems for s in C.SUFFIXES} | bases
        found |= forms - {word} | (stems & {word})
        for base in bases:
            found.update(C.HEBREW_VARIANTS.get(base, ()))
    return found


def expand(query: str) -> tuple[str, list[str]]:
    """The text to embed and what was added to it: aliases of the whole text, its words and word pairs, then variants,
    then concepts; each once, in that order."""
    parsed = parse(query)
    text = " ".join(parsed.terms)
    low = text.lower().strip()
    words, pairs = low.split(), [" ".join(p) for p in zip(low.split(), low.split()[1:])]
    added = [C.QUERY_ALIASES[x] for x in (low, *words, *pairs) if x in C.QUERY_ALIASES]
    added += [v for w in text.split() for v in C.HEBREW_VARIANTS.get(w, ())]
    added += [C.CONCEPT_ALIASES[x] for x in (low, *text.split(), *pairs) if x in C.CONCEPT_ALIASES]
    unique = list(dict.fromkeys(added))
    return " ".join([parsed.embedding_text, *unique]), unique


def variants_of(term: str, variants: set[str]) -> list[str]:
    """At most five of the variants that begin like the term once a prefix letter is off both; in sorted order, so
    that the choice is the same in every run."""
    root = _without_prefix(term)[:2]
    if len(term) < 2 or len(root) < 2:
        return []
    return [v for v in sorted(variants) if len(v) >= 2 and _without_prefix(v)[:2] == root][:MAX_VARIANTS]


def tsquery(parsed: Parsed, variants: set[str] | None = None) -> str:
    """The query in text-search notation."""
    parts = ["(" + " <-> ".join(f"'{w}'" for w in p.split()) + ")" for p in parsed.phrases if p.split()]
    for term in parsed.terms:
        forms = [f"'{x}'" for x in (term, *variants_of(term, variants or set()))]
        parts.append(forms[0] if len(forms) == 1 else f"({' | '.join(forms)})")
    if not parts:
        return ""
    out = (" | " if parsed.operator == "or" else " & ").join(parts)
    for x in parsed.excluded:
        out = f"({out}) & !'{x}'"
    return out


def query_tokens(text: str) -> list[str]:
    return [t for t in re.split(r"[\W_]+", text.lower()) if t]


def has_all(tokens: Column, wanted: list[str]) -> Column:
    """Every token is there (no tokens: nothing matches)."""
    return reduce(lambda a, b: a & b, [F.array_contains(tokens, w) for w in wanted]) if wanted else F.lit(False)


def has_phrase(tokens: Column, wanted: list[str]) -> Column:
    """The tokens follow one another."""
    if len(wanted) < 2:
        return has_all(tokens, wanted)
    # Tokens hold no blanks, so a run of them is a substring of the joined tokens.
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")).contains(f" {' '.join(wanted)} ")


def predicate(tokens: Column, parsed: Parsed, variants: set[str] | None = None) -> Column:
    """The compiled query over an array of tokens. A query of exclusions alone compiles to nothing that matches."""
    parts = [has_phrase(tokens, query_tokens(p)) for p in parsed.phrases if p.split()]
    parts += [reduce(lambda a, b: a | b, [has_phrase(tokens, query_tokens(x)) for x in (t, *variants_of(t, variants or set()))]) for t in parsed.terms]
    if not parts:
        return F.lit(False)
    out = reduce((lambda a, b: a | b) if parsed.operator == "or" else (lambda a, b: a & b), parts)
    for x in parsed.excluded:
        out = out & ~has_all(tokens, query_tokens(x))
    return out


def plain(text: str) -> list[str]:
    """A raw query's tokens, all of which must match."""
    return query_tokens(text)


def _equals(word: str):
    return lambda t: t == word


def frequency_rank(counts: dict[str, Column]) -> Column:
    """Each token adds 0.1 * sum of 1 / j^2 over its occurrences j, divided by pi^2 / 6 and by the number of tokens. A
    single hit of a single token gives .0608."""
    total = F.lit(0.0)
    for n in counts.values():
        total = total + F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda s, j: s + F.lit(0.1) / (j * j))).otherwise(0.0)
    return total / F.lit(1.64493406685) / len(counts) if counts else F.lit(0.0)


def rank(tokens: Column, wanted: list[str]) -> Column:
    """The frequency rank of a token array."""
    return frequency_rank({w: F.size(F.filter(tokens, _equals(w))) for w in dict.fromkeys(wanted)})


def positions(tokens: Column, word: str) -> Column:
    """Where a word stands in a token array, from 0; null if nowhere."""
    return F.when(F.array_contains(tokens, word), F.array_compact(F.transform(tokens, lambda t, i: F.when(t == word, i))))


# The distance rank of text search. A pair of positions d apart weighs 0.1 times the root of this.
def _nearness(d: int) -> float:
    return 1.0 / (1.005 + 0.05 * math.exp(d / 1.5 - 2))


#: Pairs farther apart weigh 1e-16 each, nothing beside any other.
FARTHEST = 100
#: ln(1 - weight) of a pair, by distance from 1 on.
_PAIR = [math.log1p(-0.1 * math.sqrt(_nearness(d))) for d in range(1, FARTHEST + 1)]
#: The rank of a match without a pair.
LEAST_RANK = 1e-20


def _pairs(a: Column, b: Column) -> Column:
    """The sum of ln(1 - weight) over all pairs of positions of two tokens; 0 if one has none. Positions of one token
    are sets, so the pairs d apart are counted by an intersection: the work grows with the lists' length, not with
    their product."""
    apart = lambda d: F.size(F.array_intersect(a, F.transform(b, lambda x: x - d))) + F.size(F.array_intersect(a, F.transform(b, lambda x: x + d)))
    each = F.transform(F.lit(_PAIR), lambda w, i: w * apart(i + 1))
    return F.when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(F.aggregate(each, F.lit(0.0), lambda s, x: s + x))


def _pairs_bound(m: Column, n: Column) -> Column:
    """The least that ``_pairs`` can be with so many positions: a distance has at most two partners for each position
    of the rarer token, and there are m * n pairs."""
    most, whole = 2 * F.least(m, n), m.cast("double") * n
    each = F.transform(F.lit(_PAIR), lambda w, i: w * F.greatest(F.lit(0.0), F.least(most.cast("double"), whole - i * most)))
    return F.aggregate(each, F.lit(0.0), lambda s, x: s + x)


def _real(rank: Column) -> Column:
    """A rank is a number of single precision, so that rows with equal positions have equal ranks."""
    return rank.cast("float").cast("double")


def _joined(sums: list[Column]) -> Column:
    return _real(F.greatest(-F.expm1(reduce(lambda a, b: a + b, sums)), F.lit(LEAST_RANK)))


@dataclass
class Compiled:
    """A query by its tokens. parts: what must match, each a list of alternatives, each of these a run of tokens;
    ``one`` of the parts or all of them; gone: runs of tokens that a match must not hold all of."""

    parts: list[list[list[str]]]
    gone: list[list[str]] = field(default_factory=list)
    one: bool = False
    #: The tokens that the frequency rank counts.
    wanted: list[str] = field(default_factory=list)

    def words(self) -> list[str]:
        return list(dict.fromkeys([t for part in self.parts for run in part for t in run] + [t for run in self.gone for t in run]))

    def _over(self, run) -> Column:
        parts = [reduce(lambda a, b: a | b, [run(r) for r in part]) for part in self.parts if part]
        if not parts:
            return F.lit(False)
        return reduce((lambda a, b: a | b) if self.one else (lambda a, b: a & b), parts)

    def match(self, at: dict[str, Column]) -> Column:
        """The predicate over each token's positions (null: none)."""

        def run(tokens: list[str]) -> Column:
            held = [at[t].isNotNull() for t in tokens]
            if not held:
                return F.lit(False)
            found = reduce(lambda a, b: a & b, held)
            if len(tokens) > 1:
                starts = at[tokens[0]]
                for k, t in enumerate(tokens[1:], 1):
                    starts = F.array_intersect(starts, F.transform(at[t], _back(k)))
                found = found & (F.size(starts) > 0)
            return found

        out = self._over(run)
        for tokens in self.gone:
            if tokens:
                out = out & ~reduce(lambda a, b: a & b, [at[t].isNotNull() for t in tokens])
        return out

    def may_match(self, counts: dict[str, Column]) -> Column:
        """Whether rows with at most so many of each token can match."""
        return self._over(lambda tokens: reduce(lambda a, b: a & b, [counts[t] > 0 for t in tokens]) if tokens else F.lit(False))

    def joins(self) -> bool:
        """Does the query as a whole join tokens (by AND, a phrase or an exclusion), or choose among them?"""
        if any(self.gone):
            return len(self.words()) > 1
        if self.one and len(self.parts) > 1 or len(self.parts) == 1 and len(self.parts[0]) > 1:
            return False
        return len(self.words()) > 1

    def rank_by_distance(self, at: dict[str, Column]) -> Column:
        """The rank over each token's positions: by distances if the query joins tokens, else by frequency."""
        words = self.words()
        if not self.joins():
            return _real(frequency_rank({w: F.when(at[w].isNotNull(), F.size(at[w])).otherwise(0) for w in words}))
        return _joined([_pairs(at[a], at[b]) for a, b in combinations(words, 2)])

    def distance_bound(self, counts: dict[str, Column]) -> Column:
        """At least the rank of any row with at most so many of each token."""
        words = self.words()
        if not self.joins():
            return _real(frequency_rank({w: counts[w] for w in words}))
        return _joined([_pairs_bound(counts[a], counts[b]) for a, b in combinations(words, 2)])


def _back(k: int):
    return lambda x: x - k


def compiled(parsed: Parsed, variants: set[str] | None = None) -> Compiled:
    parts = [[query_tokens(p)] for p in parsed.phrases if p.split()]
    parts += [[query_tokens(x) for x in (t, *variants_of(t, variants or set()))] for t in parsed.terms]
    wanted = [t for x in (*parsed.phrases, *parsed.terms) for t in query_tokens(x)]
    return Compiled(parts, [query_tokens(x) for x in parsed.excluded], parsed.operator == "or", list(dict.fromkeys(wanted)))


def compiled_plain(query: str) -> Compiled:
    """A raw query: all of its tokens."""
    tokens = list(dict.fromkeys(plain(query)))
    return Compiled([[[t]] for t in tokens], wanted=tokens)
