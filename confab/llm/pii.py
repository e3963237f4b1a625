"""Personal information in free text: found, and replaced by typed placeholders.

Numbers and addresses have written forms, given by small grammars. Names have none:
which words are names is estimated from the corpus. Anchors are places where a
person is certainly named (speaker tags with two words and signatures). How strongly
a term reveals a protected entity is the pointwise information between the term and
its place in an anchor,

    disclosure(term) = log2( P(anchor | term) / P(anchor) ),

counted over all documents. Terms whose disclosure exceeds a threshold are name
words; a given name (or an initial) and a surname beside each other are a name
wherever they stand, and are replaced. Endings of surnames are scored in the same
way, for surnames that no anchor shows. So are words that disclose a street (the last
word of a name after a house number, behind words like "lives at") and words that
disclose a phone number (the word before a number with a country code): numbers and
names of streets beside them are found without further cues.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confab.llm import labels
from confab.session import checkpointed


@lru_cache(1 << 17)
def fold(word: str) -> str:
    return labels.fold(word)


#: Bits above which a term counts as a name word, and an ending as one of surnames.
TERM_BITS, ENDING_BITS = 2.0, 6.0
#: The same for words that disclose streets and phone numbers, and how often they must do so.
CUE_BITS, LEAST_CUES = 6.0, 2
#: Up to so many name words go to the executors as one list; of more, each text gets those that it has.
LIST_TERMS = 300_000
KINDS = ("email", "phone", "idnum", "address", "name")

_H = r"[^\S\r\n]"  # white space within a line
_L = r"[^\W\d_]"
_WORD = re.compile(rf"{_L}+")
_MARKED = re.compile("[^\u0300-\u036f][\u0300-\u036f]+")
_ANCHORS = re.compile(
    rf"^(?:\*\*({_L}+){_H}({_L}+)\*\*{_H}\[|\[\d+:\d\d(?::\d\d)?\]{_H}({_L}+){_H}({_L}+):|--{_H}?\r?\n({_L}+){_H}({_L}+){_H}?\r?$)", re.M
)


_CODED, _WORD_BEFORE = re.compile(r"\+\d"), re.compile(rf"({_L}+)[.:]?{_H}\(?$")
_STREET_CUES = ("lives at ", "deliver to ", "waits outside ", "address ", "address: ")
_HOUSED = re.compile(rf"\b(?:lives at|deliver to|waits outside|address(?: is)?:?){_H}(?:(?:flat|apartment|apt\.?|unit){_H}\d+\w?,{_H})?\d{{1,4}}[a-z]?{_H}(?:{_L}+['’]?{_L}*{_H}){{1,3}}?({_L}+)(?=[,.;]|{_H}?$)", re.M)
_COUNTS = ("times", "as_first", "as_last", "as_street", "as_phone")


def composed(text: str) -> tuple[str, list[int] | None]:
    """The text with composed letters, and where each of its characters starts in the original (None: at its own place)."""
    if unicodedata.is_normalized("NFC", text):
        return text, None
    out, at, done = [], [], 0
    for m in _MARKED.finditer(text):
        part = unicodedata.normalize("NFC", m.group())
        out += [text[done : m.start()], part]
        at += [*range(done, m.start()), *[m.start()] * len(part)]
        done = m.end()
    out.append(text[done:])
    return "".join(out), [*at, *range(done, len(text) + 1)]


# ---- corpus statistics ----


def term_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """term, spelling, times, as_first, as_last: words folded and as spelt in small letters, over all texts.

    Endings (four letters) are terms that start with '-'; their spelling is null.

    Counted within each partition before anything is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, first, last, street, phone = sources = tuple(Counter() for _ in _COUNTS)

        def flush() -> pa.RecordBatch:
            rows: dict[tuple[str, str | None], list[int]] = {}
            for i, source in enumerate(sources):
                for w, n in source.items():
                    f = fold(w)
                    rows.setdefault((f, w), [0] * len(_COUNTS))[i] += n
                    if len(f) > 5 and i < 3:
                        rows.setdefault(("-" + f[-4:], None), [0] * len(_COUNTS))[i] += n
            counts = list(zip(*rows.values()))
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in rows], pa.string()), pa.array([k[1] for k in rows], pa.string()), *(pa.array(c, pa.int64()) for c in counts)], ["term", "spelling", *_COUNTS])
            for c in sources:
                c.clear()
            return out

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    t, _ = composed(t)
                    low = t.lower()
                    times.update(_WORD.findall(low))
                    for m in _ANCHORS.finditer(t):
                        a, z = (x for x in m.groups() if x)
                        first[a.lower()] += 1
                        last[z.lower()] += 1
                    for m in _CODED.finditer(low):
                        if w := _WORD_BEFORE.search(low[_back(low, _line(low, m.start()), m.start(), 1) : m.start()]):
                            phone[w.group(1)] += 1
                    if any(cue in low for cue in _STREET_CUES):
                        street.update(_HOUSED.findall(low))
            if len(times) > 200_000:
                yield flush()
        if times:
            yield flush()

    counts = df.select(text).mapInArrow(run, "term string, spelling string, " + ", ".join(f"{c} long" for c in _COUNTS))
    return counts.groupBy("term", "spelling").agg(*(F.sum(c).alias(c) for c in _COUNTS))


def disclosure(counts: DataFrame) -> DataFrame:
    """term, role ('given', 'surname', 'street' or 'phone'), bits, spellings: name words, endings and cues above the thresholds."""
    words = ~F.col("term").startswith("-")
    counts = counts.groupBy("term").agg(*((F.sum(c) if c in counts.columns else F.lit(0).cast("long")).alias(c) for c in _COUNTS), F.collect_list("spelling").alias("spellings"))
    alls = (F.sum(F.when(words, F.col(c))).alias(f"all_{c}") for c in ("times", "as_first", "as_street", "as_phone"))
    c = counts.where("as_first + as_last + as_street + as_phone > 0").join(F.broadcast(counts.agg(*alls)))  # one row of totals

    def bits(n: str, total: str):
        return F.log2(F.try_divide(F.try_divide(F.col(n), F.col("times")), F.try_divide(F.col(total), F.col("all_times"))))

    roles = (
        ("given", "as_first", "all_as_first", words & (F.col("as_first") * 3 >= F.col("as_last")) & (F.col("as_first") > 0), F.lit(TERM_BITS)),
        ("surname", "as_last", "all_as_first", (~words | (F.col("as_last") * 3 >= F.col("as_first"))) & (F.col("as_last") > 0), F.when(words, TERM_BITS).otherwise(ENDING_BITS)),
        ("street", "as_street", "all_as_street", words & (F.col("as_street") >= LEAST_CUES), F.lit(CUE_BITS)),
        ("phone", "as_phone", "all_as_phone", words & (F.col("as_phone") >= LEAST_CUES), F.lit(CUE_BITS)),
    )
    found = F.array(*(F.when(which & (bits(n, total) >= least), F.struct(F.lit(role).alias("role"), bits(n, total).alias("bits"))) for role, n, total, which, least in roles))
    return c.select("term", "spellings", F.explode(F.filter(found, lambda r: r.isNotNull())).alias("r")).select("term", "r.role", "r.bits", "spellings")


def _by_role(rows: Iterable) -> dict[str, dict[str, list[str]]]:
    out: dict[str, dict[str, list[str]]] = {"given": {}, "surname": {}, "ending": {}, "street": {}, "phone": {}}
    for r in rows:
        if r["term"].startswith("-"):
            out["ending"][r["term"][1:]] = []
        else:
            out[r["role"]][r["term"]] = list(r["spellings"])
    return out


def name_words(df: DataFrame, text: str = "text") -> dict[str, dict[str, list[str]]]:
    """{'given', 'surname', 'ending', 'street', 'phone'} to {term: spellings}: all name words of a corpus, each with the few spellings that fold to it."""
    return _by_role(disclosure(checkpointed(term_counts(df, text))).collect())


def _terms(text: str) -> set[str]:
    """All that `Finder` may look up for a text: its folded words, without an s at the end too, and their endings."""
    out: set[str] = set()
    low = composed(text)[0].lower()
    for w in set(_WORD.findall(low)) | set("".join(c if c.isalpha() else " " for c in low).split()):
        for f in {fold(w), fold(w[:-1])} if w.endswith("s") else {fold(w)}:
            out.add(f)
            if len(f) > 5:
                out.add("-" + f[-4:])
    return out


def _own_names(df: DataFrame, text: str, names: DataFrame) -> DataFrame:
    """text_id (a digest) and ``names`` (of all name words those that the text has), for texts that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, terms = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = _terms(t)
                ids += [i] * len(own)
                terms += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(terms, pa.string())], ["text_id", "term"])

    texts = df.select(F.sha2(F.col(text), 256).alias("text_id"), F.col(text)).where(F.col(text) != "")
    terms = texts.mapInArrow(run, "text_id string, term string")
    return terms.join(names, "term").groupBy("text_id").agg(F.collect_set(F.struct("term", "role", "spellings")).alias("names"))


# ---- written forms ----


def _a(words: str) -> str:
    """Letters that may have lost their accents."""
    for plain, full in (("a", "áä"), ("c", "č"), ("d", "ď"), ("e", "éě"), ("i", "í"), ("l", "ľ"), ("n", "ň"), ("o", "óôö"), ("r", "ř"), ("s", "š"), ("t", "ť"), ("u", "úůü"), ("y", "ý"), ("z", "ž")):
        words = re.sub(f"[{full}]", f"[{plain}{full}]", words)
    return words


_I = re.IGNORECASE
_DOTS = _a(r"dot|tečka|bodka|punkt|point")
_JOINS = _a(r"plus|podtržítko|podčiarkovník|podčiarnik|pomlčka|minus|mínus|underscore|unterstrich|bindestrich|dash|hyphen")
_ATS = _a(r"at|zavináč|klammeraffe|ät")
_AT = re.compile(rf"{_H}?@{_H}?|{_H}?[(\[]{_H}?(?:{_ATS}){_H}?[)\]]{_H}?|(?<=\w){_H}(?:{_ATS}){_H}(?=\w)", _I)
_DOT = rf"(?:\.|{_H}?[(\[]{_H}?(?:{_DOTS}){_H}?[)\]]{_H}?|{_H}(?:{_DOTS}){_H})"
#: No sign or word between two parts of an address is longer.
LONGEST_JOIN = 40
_LOCAL = re.compile(rf"(?:[\w+-]+(?:{_DOT}|{_H}(?:{_JOINS}){_H}|[(\[](?:{_JOINS})[)\]]))*[\w+-]+$", _I)
_TIGHT = re.compile(rf"[\w.+-]+(?:[(\[](?:{_DOTS}|{_JOINS})[)\]][\w.+-]+)*$", _I)
_DOT_WORD, _BLANK = re.compile(rf"{_H}(?:{_DOTS}){_H}", _I), re.compile(r"\s")
_DOMAIN = re.compile(rf"[\w-]+(?:{_DOT}[\w-]+)+", _I)

_NUMBER = re.compile(rf"[(+\d][+(\d]*(?:(?:{_H}?[/.\-–]{_H}?|{_H}?\){_H}?[/\-–]?{_H}?|{_H}?[/\-–]?{_H}?\(|{_H})\d+)*")
_CARD = re.compile(rf"\w*(?:[- ]?(?:id|nr|no|nummer|number))?\.?{_H}?:?{_H}?((?=[A-Z]*\d)(?=\d*[A-Z])[A-Z\d]{{8,12}})\b", _I)
_LAST_WORD = re.compile(rf"({_L}+)[.:]?{_H}$")
_QQ = re.compile(rf"QQ(?:{_H}?\d\d){{3}}{_H}?[A-D]\b", _I)
_ID_CUE = re.compile(_a(r"(?:rodn\w+[^\S\r\n]+čísl\w+|\brč|\br\. ?č\.|\bssn|social security(?: number| no\.?)?|national insurance(?: number| no\.?)?|\bid[ -]?(?:number|no\.?|nr\.?|číslo)|identi\w+[^\S\r\n]+(?:number|čísl\w+|nummer)|\bnino|steuer\w*(?:[- ]?(?:id|nr|nummer|identifikationsnummer))?\.?|sozialversicherung\w*|versicherten\w*|ausweis\w*|číslo (?:pojištěnce|op|občanského průkazu)|op č\.|personal\w*nummer|\btax id)\W*(?:\w{1,6}\W+)?$"), _I)
_ORDER_CUE = re.compile(_a(r"(?:\b(?:č|no|nr|nummer|ticket|zakázk\w*|zákazk\w*|faktur\w*|invoice|vorgang|celkem|celkom|total|insgesamt|server|verze|verzia|build|version|order|desk)\b)\.?\W*$"), _I)

#: Digits by name (accents removed), in four languages.
_DIGITS = set(
    "nula jedna jeden jedno dva dve tri ctyri styri pet pat sest sedm sedem osm osem devet devat "
    "zero oh one two three four five six seven eight nine double triple "
    "null eins ein zwei zwo drei vier funf sechs sieben acht neun plus".split()
)
_SPELLED = re.compile(rf"({_L}+)(?:[^\S\r\n]*[,–-]?[^\S\r\n]+|[-–]|$|\b)")

_FLAT = rf"(?:(?:flat|apartment|apt\.?|unit){_H}\d+\w?,{_H})?"
_STREET_EN = re.compile(
    rf"{_FLAT}\b\d{{1,4}}[a-z]?{_H}(?:{_L}+['’]?{_L}*{_H}){{1,3}}?(?:(?:road|street|lane|close|drive|avenue|way|court|square|terrace|crescent|place|gardens|grove|mews|hill|row|walk)\b|(?:rd|st|ln|dr|ave|cl|ct|sq)\b(?:\.(?=[.,;]|{_H}in\b))?)", _I
)
_STREET_HEAD = re.compile(rf"{_FLAT}\b\d{{1,4}}[a-z]?{_H}(?:{_L}+['’]?{_L}*{_H}){{1,3}}$", _I)
_HOUSE = re.compile(rf"(?<={_L}|\.)(?:{_H}(?:{_a('č')}\.{_H}?p\.|{_a('čp')}\.|{_a('č')}\.|nr\.|no\.))?{_H}?\d{{1,4}}(?:/\d{{1,4}})?(?:[a-z]\b|{_H}[b-h]\b(?!['’]))?(?![\d/:]|[.–-]\d|{_H}?\d)", _I)
_STREET_PREFIX = _a(r"(?:ulice|ulica|ulici|ul\.|nám\.|náměstí|námestie|třída|trieda|tř\.|nábřeží)")
_CUE_STREET = re.compile(
    rf"^.*(?:{_a('adres[ayue]')}(?:sse)?:?|\badress\w*:?|\banschrift:?|\bwohnt(?:{_H}jetzt)?(?:{_H}(?:in|an)(?:{_H}der)?)?|\bwohnhaft|\blieferung{_H}an|{_a('doručiť')}{_H}na|\bu{_H}domu|\bpri{_H}dome|(?:{_a('bydlí|býva|bydliště|bydlisko')})(?:{_H}(?:na|v))?:?|\bvor{_H}dem{_H}haus|\blives{_H}at|\bdeliver{_H}to|\bwaits{_H}outside|\baddress:?){_H}((?:{_STREET_PREFIX}{_H})?(?:{_L}+\.?{_H}?){{1,4}})$",
    _I,
)
_OWN_STREET = re.compile(rf"((?:(?:an|in){_H}der{_H})?{_L}*(?:straße|strasse|str\.|weg|gasse|allee|platz|damm|ufer|ring|steig)|{_STREET_PREFIX}{_H}(?:{_L}+{_H}?){{1,3}}|{_L}+{_H}{_a('nábřeží|náměstí|třída|nábrežie|námestie')})$", _I)
_TOKEN = re.compile(rf"{_H}*\S+")
_NO_STREET = re.compile(_a(r"^(?:v|ve|na|o|um|at|in|im|a|und|and)$"), _I)


_AFTER = re.compile(rf"{_H}(?:{_L}\.{_H}?){{0,2}}({_L}{{2,}})")
_GIVEN_AFTER = re.compile(rf",?{_H}({_L}{{2,}})")
_SURNAME_BEFORE = re.compile(rf"(?<!\w)({_L}{{3,}}),{_H}$")
_INITIAL = re.compile(rf"{_H}[^\W\d_a-z]\.(?=\W|$)")
_INITIAL_AFTER = re.compile(rf"(?:,{_H}{_L}|{_H}[^\W\d_a-z])\.(?=\W|$)")
_INITIALS_BEFORE = re.compile(rf"(?<![\w.])(?:{_L}\.{_H}?){{1,3}}$")

#: What the automaton looks for besides names: kind of trigger and words (fixed values, small letters).
_TRIGGERS = {
    "email": "@|(at|[at|(ät|[ät|zavináč|zavinac|klammeraffe| dot |\xa0dot\xa0| punkt | tečka | tecka | bodka | point ",
    "qq": "qq",
    "card": "steuer|ausweis|průkaz|prukaz|preukaz|id number|id card|passport",
    "digit": "nula|jedna|jeden|dva|tři|tri|čtyři|ctyri|štyri|styri|pět|pet|päť|pat|šest|sest|šesť|sedm|sedem|osm|osem|devět|devet|deväť|devat|"
    "zero|one|two|three|four|five|six|seven|eight|nine|null|eins|zwei|zwo|drei|vier|fünf|funf|sechs|sieben|acht|neun",
    "street": "road|street|lane|close|drive|avenue|way|court|square|terrace|crescent|place|gardens|grove|mews|hill|row|walk|rd|st|ln|dr|ave|cl|ct|sq",
    "house": "adres|anschrift|wohn|lieferung|doručit|doručiť|dorucit|domu|dome|dom|bydl|býva|byva|haus|lives at|deliver to|waits outside|"
    "straße|strasse|str.|weg|gasse|allee|platz|damm|ufer|ring|steig|ulice|ulica|ulici|ul.|nám|nam|tříd|trid|tried|tř.|nábřeží|nabrezi|nábrežie|nabrezie",
}


def _line(t: str, at: int) -> int:
    """Where the line of a place begins."""
    return t.rfind("\n", 0, at) + 1


def _back(t: str, begin: int, end: int, tokens: int) -> int:
    """A place from which `tokens` whole tokens (between white space) lead up to `end`, however long they are; `begin` if there are fewer."""
    size = 16 * tokens
    while True:
        at = max(begin, end - size)
        if at == begin:
            return begin
        parts = t[at:end].split(None, 1)
        if len(t[at:end].split()) > tokens + 1:
            return end - len(parts[1]) if len(parts) > 1 else at
        size *= 4


def _up_to(pattern: re.Pattern, t: str, begin: int, end: int) -> tuple[int, re.Match | None]:
    """A match that ends at `end`, and where the stretch begins that was searched: as much of it as the match can reach into."""
    size = 128
    while True:
        at = max(begin, end - size)
        m = pattern.search(t[at:end])
        if at == begin or m is None or m.start() > LONGEST_JOIN:
            return at, m
        size *= 4


class Finder:
    """Personal information of texts, given the name words of a corpus.

    One automaton passes over the text in small letters and tells where something
    may stand; the forms are looked for around those places only.
    """

    def __init__(self, names: dict[str, dict[str, list[str]]]):
        import ahocorasick

        self.given, self.surname, self.ending = (set(names[k]) for k in ("given", "surname", "ending"))
        kinds: dict[str, set[str]] = {}
        for kind, words in _TRIGGERS.items():
            for w in words.split("|"):
                kinds.setdefault(w, set()).add(kind)
        for kind, roles in (("name", ("given", "surname")), ("learnt", ("street",))):
            for role in roles:
                for term, spellings in names.get(role, {}).items():
                    for w in {term, *spellings}:
                        kinds.setdefault(w, set()).add(kind)
        self.phone = set(names.get("phone", ()))
        self.triggers = ahocorasick.Automaton()
        for w, k in kinds.items():
            self.triggers.add_word(w, (len(w), tuple(k)))
        self.triggers.make_automaton()
        self.role: dict[str, int] = {}

    def _role(self, word: str) -> int:
        """1: given name, 2: surname, 3: both, 0: neither."""
        if (r := self.role.get(word)) is None:
            if len(self.role) > 1 << 18:
                self.role.clear()
            f = fold(word)
            r = self.role[word] = (f in self.given) + 2 * (f in self.surname)
        return r

    def find(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, kind) in order, without overlaps."""
        if not text:
            return []
        t, at = composed(text)
        low = t.lower()
        if len(low) != len(t):  # a few capitals have longer small forms
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in t)
        spans: list[tuple[int, int, str]] = []
        taken = bytearray(len(t))

        def take(start: int, end: int, kind: str) -> None:
            if start < end and not any(taken[start:end]):
                taken[start:end] = b"\1" * (end - start)
                spans.append((start, end, kind))

        hits: dict[str, list[tuple[int, int]]] = {"email": [], "qq": [], "card": [], "digit": [], "street": [], "house": [], "name": [], "learnt": []}
        for last, (size, kinds) in self.triggers.iter(low):
            for k in kinds:
                hits[k].append((last + 1 - size, last + 1))
        done = 0
        for a, z in hits["email"]:  # each line that has such a sign or word is read once
            if a >= done:
                begin, done = max(done, _line(t, a)), t.find("\n", z)
                done = len(t) if done < 0 else done
                for m in _AT.finditer(t, begin, done):
                    self._email(t, m, take)
        for a, _ in hits["qq"]:
            if m := _QQ.match(t, a):
                take(m.start(), m.end(), "idnum")
        for _, z in hits["card"]:
            if m := _CARD.match(t, z):
                take(m.start(1), m.end(1), "idnum")
        for m in _NUMBER.finditer(t):
            self._number(t, m, take)
        self._dictated(low, t, hits["digit"], take)
        done = 0
        for a, z in hits["street"]:
            if a and not low[a - 1].isalnum() and not low[z : z + 1].isalnum():
                begin = max(done, _back(t, _line(t, a), a, 7))
                for m in _STREET_EN.finditer(t, begin, min(len(t), z + 4)):
                    if m.end() >= z:
                        take(m.start(), m.end(), "address")
                        done = m.end()
        for a, z in hits["learnt"]:
            if a and t[a].isupper() and not low[a - 1].isalnum() and not low[z : z + 1].isalnum():
                begin = _back(t, _line(t, a), a, 6)
                if m := _STREET_HEAD.search(t[begin:a]):
                    take(begin + m.start(), z, "address")
        done = -1
        for _, z in hits["house"]:
            if z <= done:
                continue
            # the house number follows within four words, which the rule of the street checks
            end = z
            for _ in range(6):
                if not (w := _TOKEN.match(t, end)):
                    break
                end = w.end()
            m = _HOUSE.search(t, z - 1, end)
            if m:
                done = z
                self._house(t, m, take)
        self._names(t, low, hits["name"], take)
        spans.sort()
        return spans if at is None else [(at[a], at[z], k) for a, z, k in spans]

    def _email(self, t: str, m: re.Match, take) -> None:
        begin, local = _up_to(_LOCAL, t, _line(t, m.start()), m.start())
        domain = _DOMAIN.match(t, m.end())
        if not local or not domain:
            return
        signs = "@" in m.group() or m.group().strip()[0] in "(["
        if not signs and not _DOT_WORD.search(domain.group()):  # words only: the domain's dots must be words too
            return
        start = begin + local.start()
        if signs and _BLANK.search(local.group()):
            # an address with signs takes no words before it but through spelled dots
            begin, tail = _up_to(_TIGHT, t, _line(t, m.start()), m.start())
            start = begin + tail.start()
        while t[start] in ".-+":
            start += 1
        take(start, domain.end(), "email")

    def _number(self, t: str, m: re.Match, take) -> None:
        s, start, end = m.group(), m.start(), m.end()
        if len(s) < 7 or t[end : end + 1] == ":" or (start and (t[start - 1].isalnum() or t[start - 1] in "_.,:/@+-")):
            return
        if s[0] == "(" and ")" not in s:
            s, start = s[1:], start + 1
        d = re.sub(r"\D", "", s)
        before = t[_back(t, _line(t, start), start, 6) : start]
        if _ID_CUE.search(before):
            if 8 <= len(d) <= 13:
                take(start, end, "idnum")
            return
        if _ORDER_CUE.search(before) and s[0] not in "+(":
            return
        groups = re.findall(r"\d+", s)
        shape = tuple(map(len, groups))
        if s[0] == "+" or s[:2] == "(+":
            ok = 10 <= len(d) <= 14
        elif d.startswith("00"):
            ok = 11 <= len(d) <= 15
        elif s[0] == "(":
            ok = 9 <= len(d) <= 12
        elif re.fullmatch(r"\d{6}\s?[/-]\s?\d{3,4}|\d\d[ \xa0.]\d\d[ \xa0.]\d\d\s?[/-]\s?\d{3,4}", s) or (shape in ((3, 2, 4), (2, 3, 3, 3), (3, 4, 4)) and (d[0] == "0" or shape == (3, 2, 4))):
            take(start, end, "idnum")
            return
        else:
            ok = shape in ((3, 3, 3), (3, 3, 4), (1, 3, 3, 4), (9,), (10,), (5, 3, 3), (5, 6), (3, 2, 2, 2)) or (d[0] == "0" and 9 <= len(d) <= 12 and len(shape) <= 4)
            if shape == (3, 3, 3) and "." in s and s.count(".") == 3:
                ok = False
        if not ok and 7 <= len(d) <= 12 and self.phone:  # no form of its own: the word before it must tell
            cue = _LAST_WORD.search(before)
            ok = bool(cue) and fold(cue.group(1)) in self.phone
        if ok:
            take(start, end, "phone")

    def _dictated(self, low: str, t: str, hits: list[tuple[int, int]], take) -> None:
        done = 0
        for i, z in hits:
            if i < done or (i and low[i - 1].isalpha()) or low[z : z + 1].isalpha():
                continue
            n, at, last = 0, i, z
            while (m := _SPELLED.match(low, at)) and fold(m.group(1)) in _DIGITS:
                n, last, at = n + 1, m.end(1), m.end()
            done = last
            if n >= 7:
                head = re.search(rf"\bplus{_H}$", low[max(0, i - 6) : i])
                start = i - (len(head.group()) if head else 0)
                before = t[_back(t, _line(t, start), start, 6) : start]
                take(start, last, "idnum" if _ID_CUE.search(before) else "phone")

    def _house(self, t: str, m: re.Match, take) -> None:
        begin = _back(t, _line(t, m.start()), m.start(), 10)
        before = t[begin : m.start()]
        c = _CUE_STREET.search(before) or _OWN_STREET.search(before)
        if not c or _NO_STREET.match(c.group(1).split()[-1]):
            return
        take(begin + c.start(1), m.end(), "address")

    def _names(self, t: str, low: str, hits: list[tuple[int, int]], take) -> None:
        """Around each name word: given name and surname, surname and given name, initials and surname."""
        done = 0
        for a, z in hits:
            if a < done or (a and (low[a - 1].isalpha() or low[a - 1] in "@_")) or low[z : z + 1].isalpha():
                continue
            r = self._role(low[a:z])
            start = end = -1
            if r & 1:
                m = _AFTER.match(t, z)
                if m and (size := self._surname(t, low, m.start(1), m.end(1), a)):
                    start, end = a, m.start(1) + size
                elif m := _SURNAME_BEFORE.search(t, max(done, _back(t, _line(t, a), a, 1)), a):  # an unknown surname in front, set off by a comma
                    f = fold(m.group(1))
                    if len(f) > 5 and f[-4:] in self.ending and (m.group(1)[0].isupper() or not t[a].isupper()):
                        start, end = m.start(1), z
            if start < 0 and r & 2:
                m = _GIVEN_AFTER.match(t, z)
                if m and self._role(low[m.start(1) : m.end(1)]) & 1 and not (_AFTER.match(t, m.end(1)) and self._surname(t, low, *_AFTER.match(t, m.end(1)).span(1), m.start(1)) and "," not in t[z : m.start(1)]):
                    start, end = a, m.end(1)
                    if tail := _INITIAL.match(t, end):
                        end = tail.end()
                elif m := _INITIALS_BEFORE.search(t, max(done, _back(t, _line(t, a), a, 3)), a):
                    start, end = m.start(), a + self._surname(t, low, a, z, None)
                elif m := _INITIAL_AFTER.match(t, z):
                    start, end = a, m.end()
            if start >= 0:
                take(start, end, "name")
                done = end

    def _surname(self, t: str, low: str, a: int, z: int, given: int | None) -> int:
        """Length of the surname at a word (without a possessive s), 0 if it is none."""
        word = low[a:z]
        if self._role(word) & 2:
            return z - a
        if word.endswith("s") and self._role(word[:-1]) & 2:
            return z - a - 1
        f = fold(word)
        if len(f) > 5 and f[-4:] in self.ending and given is not None and (t[a].isupper() or not t[given].isupper()):
            return z - a
        return 0


def placeholder(kind: str) -> str:
    return f"[{kind.upper()}]"


def find_personal(df: DataFrame, key: str = "doc_id", text: str = "text", names: dict[str, dict[str, list[str]]] | None = None) -> DataFrame:
    """The key, ``clean`` (the text with placeholders) and ``found`` (ARRAY<STRUCT<kind, found>>).

    `names` are name words (``name_words``); if not given they are estimated from all
    texts of `df`. found holds each piece as it stands in the text, in order, repeats
    included; the rest of the text is unchanged. Null texts stay null and empty ones
    empty, both with nothing found. Rows that repeat are treated alike; keys may be
    null. Other columns are not read.

    Plan: one pass that counts terms (pre-aggregated, one shuffle of the vocabulary),
    one map over the texts, which are not shuffled. With more than LIST_TERMS name
    words the list is joined to the words of the texts, and what each text has of it
    to the text (which shuffles them); the rows are the same.
    """
    rows = df.select(key, text)
    if names is None:
        every = checkpointed(disclosure(checkpointed(term_counts(df, text))).select("term", "role", "spellings"))
        if every.count() > LIST_TERMS:
            own = _own_names(df, text, every)
            rows = df.select(key, text, F.sha2(F.col(text), 256).alias("text_id")).join(own, "text_id", "left").select(key, text, "names")
        else:
            names = _by_role(every.collect())  # LIST_TERMS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = None if names is None else Finder(names)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("found", pa.string())]))
        for b in batches:
            if names is None:
                finder = Finder(_by_role(n for own in b.column(2).to_pylist() for n in own or ()))
            clean, found = [], []
            for t in b.column(1).to_pylist():
                spans, parts, at = finder.find(t), [], 0
                for a, z, k in spans:
                    parts += [t[at:a], placeholder(k)]
                    at = z
                clean.append("".join([*parts, t[at:]]) if spans else t)
                found.append([{"kind": k, "found": t[a:z]} for a, z, k in spans])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(clean, pa.string()), pa.array(found, kind)], [key, "clean", "found"])

    return rows.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, clean string, found array<struct<kind:string,found:string>>")
