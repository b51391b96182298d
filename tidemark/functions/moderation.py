"""Words that a public comment must not hold, found through common disguises.

`normalised` undoes disguises by expressions on columns: case, accents, letters of other scripts that look Latin, digits and signs for letters, and letters set apart. Repeated
letters stay, as a term may need them: a letter that stands n times in a term stands n times or more in the text, so "asss" holds "ass" and "as" does not.

`flagged_words` searches the words of the normalised text with one automaton for all terms, over words whose repeated letters are folded, and checks the repeats of what it finds. A
term of up to WHOLE letters must be the whole word, a longer one may stand inside it. Innocent words are cut out first, from the left and the longest first. The lists are parameters; those here are defaults without slurs,
which a community adds as it needs. Lists are held by each task: MAX_TERMS bounds them.

A null text has the empty normal form and no such word.
"""

import itertools
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WHOLE = 3
MAX_TERMS = 100_000
#: Words that a task remembers its verdict on.
REMEMBERED = 200_000

TERMS = """
abomination airhead arse arsehole ass asshole asshat bastard beatdown bellend birdbrain bitch blockhead bloody blowhard bollocks bonehead bootlicker bozo braindead brainless bugger bullshit buffoon
charlatan chump clod clown cockwomble coward crap crapper cretin cringelord creep damn degenerate deadbeat deranged despicable dickhead dimwit dipshit dirtbag disgrace disgusting dolt donkeybrain doofus dork
douche douchebag dullard dumbass dumbo dunce dunderhead eejit egomaniac fathead filth fool fraudster freeloader freak fuck fucker fuckwit garbage git goddamn goon halfwit hag horseshit hypocrite idiot idiotic
imbecile incompetent ingrate jackass jerk knobhead knucklehead lackwit laughingstock leech liar loser lowlife lunatic maggot meathead misfit moron moronic motherfucker muppet nincompoop nitwit numbskull nutjob
oaf pathetic parasite pighead piss pissant pisshead prat prick psycho scum scumbag shit shithead shitty sleaze slimeball sod stupid thickhead toad trash twat twit vermin wanker weasel worthless wretch wuss
""".split()
INNOCENT = """
arsenal arsenic coarse cockroach creeper crapaud crappie damnation diffuse foolproof foolscap freakish hearse jerkin jerky leeching matsushita mishit parse pissarro prickle prickly rehearse scumble
shiitake shitake sodium sparse toadstool toadflax trashcan twitter weaselly scrape scrapper scrappy clownfish pratfall sprat crapshoot skyscraper
""".split()

_CAPITALS = {chr(c - 32): chr(c) for c in range(ord("a"), ord("z") + 1)}
#: Letters of other scripts that look like Latin ones.
_ALIKE = dict(zip("авеікмнорстухѕјαβεικνορτυχℓ", "abeikmhopctyxsjabeiknoptyxl", strict=True))
#: Digits and signs that stand for letters.
SIGNS = ("013457@$|€", "oieastasle")


def _latin() -> dict[str, str]:
    """Accented and wide letters by their decomposition."""
    found = {}
    for c in map(chr, itertools.chain(range(0xC0, 0x250), range(0x1E00, 0x1F00), range(0xFF21, 0xFF5B))):
        base = unicodedata.normalize("NFKD", c)[0].lower()
        if "a" <= base <= "z":
            found[c] = base
    return found


_LETTERS = _CAPITALS | {c.upper(): x for c, x in _ALIKE.items() if len(c.upper()) == 1 and not c.upper().isascii()} | _ALIKE | _latin()
LETTERS = ("".join(_LETTERS), "".join(_LETTERS.values()))


def normalised(text: Column) -> Column:
    """Words of the letters a to z, with one blank between them. Digits and signs without a letter or @ beside them are none."""
    x = F.translate(F.coalesce(text, F.lit("")), *LETTERS)
    x = F.regexp_replace(F.concat(F.lit(" "), F.regexp_replace(x, r"[\t\n\r]", " "), F.lit(" ")), r" [^a-z@]+ ", " ")
    x = F.regexp_replace(F.translate(F.regexp_replace(x, "!([a-z])", "i$1"), *SIGNS), r"[^a-z]+", " ")
    x = F.replace(F.regexp_replace(x, r"\b([a-z])\b", "<$1>"), F.lit("> <"), F.lit(""))
    return F.trim(F.regexp_replace(x, "[<>]", ""))


def runs(word: str) -> tuple[str, list[int]]:
    """The letters with repeats folded, and how often each stands."""
    groups = [(c, sum(1 for _ in g)) for c, g in itertools.groupby(word)]
    return "".join(c for c, _ in groups), [n for _, n in groups]


class Terms:
    """An automaton over the folded terms, and the innocent words."""

    def __init__(self, terms: list[str], innocent: list[str]):
        if len(terms) + len(innocent) > MAX_TERMS:
            raise ValueError(f"more than {MAX_TERMS} terms")
        by_letters: dict[str, list[tuple[list[int], bool]]] = {}
        for term in terms:
            letters, counts = runs(term)
            by_letters.setdefault(letters, []).append((counts, len(term) <= WHOLE))
        self.automaton = ahocorasick.Automaton()
        for letters, wanted in by_letters.items():
            self.automaton.add_word(letters, wanted)
        self.automaton.make_automaton()
        self.innocent = ahocorasick.Automaton()
        for word in innocent:
            self.innocent.add_word(runs(word)[0], len(runs(word)[0]))
        self.innocent.make_automaton()
        self.known: dict[str, bool] = {}

    def _holds(self, word: str) -> bool:
        letters, counts = runs(word)
        if not len(self.automaton):
            return False
        for last, n in self.innocent.iter_long(letters) if len(self.innocent) else ():
            counts[last + 1 - n : last + 1] = [0] * n
        for last, wanted in self.automaton.iter(letters):
            for least, whole in wanted:
                found = counts[last + 1 - len(least) : last + 1]
                if (not whole or len(least) == len(letters)) and all(a >= b for a, b in zip(found, least, strict=True)):
                    return True
        return False

    def holds(self, word: str) -> bool:
        verdict = self.known.get(word)
        if verdict is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            verdict = self.known[word] = self._holds(word)
        return verdict


def flagged_words(normal: Column, terms: list[str] = TERMS, innocent: list[str] = INNOCENT) -> Column:
    """The words of a normalised text that hold a term, in order."""

    @F.pandas_udf("array<string>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        search = Terms(terms, innocent)
        for texts in batches:
            yield texts.map(lambda t: [w for w in (t or "").split(" ") if w and search.holds(w)])

    return found(normal)


def pattern(terms: list[str] = TERMS) -> str:
    """The same search as one regular expression on a word, for engines without the automaton."""

    def of(term: str) -> str:
        letters, counts = runs(term)
        body = "".join(c + ("+" if n == 1 else f"{{{n},}}") for c, n in zip(letters, counts, strict=True))
        return f"^{body}$" if len(term) <= WHOLE else body

    return "|".join(map(of, terms))


def innocent_pattern(innocent: list[str] = INNOCENT) -> str:
    folded = sorted({runs(w)[0] for w in innocent}, key=lambda w: (-len(w), w))
    return "|".join("".join(c + "+" for c in w) for w in folded)
