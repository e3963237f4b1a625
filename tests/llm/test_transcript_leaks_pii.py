import random

import pytest

from confab.llm import leaks, pii, transcript
from confab.llm.transcript import FILLER, SOUND, TIME, Utterance

BL = "call_id string, block_no int, speaker string, start double, end double, text string, time string"
TR = "call_id string, idx int, title string"


@pytest.mark.parametrize(
    "text,flags,tag,clean",
    [
        ("[01:37] - **SPEAKER 3** ehm... Hned (ten hm druhý) [ potlesk ]", TIME | FILLER | SOUND, "SPEAKER 3", "Hned (ten druhý)"),
        ("00:09:10,582 --> 00:09:11,610 While recording", TIME, None, "While recording"),
        ("V 10:30 jsme", 0, None, "V 10:30 jsme"),
        ("leitete die Zentrale um halt eine leise Leitung", 0, None, "leitete die Zentrale um halt eine leise Leitung"),
        ("Um 10:30 Uhr verglichen wir", 0, None, "Um 10:30 Uhr verglichen wir"),
        ("We um split the box, er, and ((crosstalk)) (laughs)", FILLER | SOUND, None, "We split the box, and"),
        ("(the [inaudible] second one)", SOUND, None, "(the second one)"),
        ("03:01:21 -\nDispečer: v pondělí", TIME, "Dispečer", "v pondělí"),
        ("Speaker 3 >> On Thursday ♪♪", SOUND, "Speaker 3", "On Thursday"),
        ("*kašel* přesně tak: ano <noise> {typing}", SOUND, None, "přesně tak: ano"),
        ("", 0, None, ""),
        ("((", 0, None, "(("),
        ("We saw (dog barking) nothing (rain) (sirens outside) here (wind howling)", SOUND, None, "We saw nothing here"),
        ("So (audience laughs and claps for a while, then it goes on and on until nobody can hear what is said) yes", SOUND, None, "So yes"),
        ("yes *" + "loud music " * 9 + "* no [" + "static " * 40 + "] on", SOUND, None, "yes no on"),
        ("(a street that nobody of us had ever seen before, as we said) yes (hm)", FILLER, None, "(a street that nobody of us had ever seen before, as we said) yes"),
        ("Very" + " Long" * 30 + ": hello", 0, "Very" + " Long" * 30, "hello"),
    ],
)
def test_grammar(text, flags, tag, clean):
    u = Utterance(text)
    assert (u.flags, u.tag, u.clean(True)) == (flags, tag, clean)


def test_plain_and_hostile_texts_take_linear_time():
    import time

    began = time.time()
    for t in ("a, " * 50_000, "a" * 100_000, " " * 100_000, "(" * 2_000, "[a" * 500, "e" * 100_000 + "m", "- " * 50_000, "*" * 50_000):
        Utterance(t).clean(True)
    assert time.time() - began < 20


def test_turns_across_partitions(small_batches):
    rnd = random.Random(4)
    tracks = [(c, i, n) for c in "ab" for i, n in ((0, "Eva"), (2, None))]
    rows = [(rnd.choice("aab"), i, rnd.choice(["Eva", "eva:", "Speaker 2", "track2"]), float(rnd.randrange(300)), 400.0, rnd.choice(["hello", "hm", "[01:02] yes", ""]), "x") for i in range(90)]
    rows += rows[:9]
    c = transcript.clean_blocks(small_batches.createDataFrame(rows, BL), small_batches.createDataFrame(tracks, TR)).collect()
    assert len(c) == 90
    want = set()
    for call in "ab":
        last = None
        for r in sorted({r for r in rows if r[0] == call}, key=lambda r: (r[3], r[1])):
            if r[5] in ("hello", "[01:02] yes"):
                idx = 0 if r[2].startswith(("E", "e")) else 2
                if idx != last:
                    want.add((call, r[1], idx))
                last = idx
    assert {(r.call_id, r.block_no, r.idx) for r in c if r.turn_block == r.block_no} == want
    assert {r.block_no for r in c if r.label} == {r[1] for r in rows if r[2] in ("eva:", "track2")}


def test_turn_texts_and_tagged_blocks(spark):
    rows = [("c", 1, "", 0.0, 1.0, "Eva: hm, ahoj", "x"), ("c", 2, "Eva", 1.0, 2.0, "tak jo", "x"), ("c", 3, "Speaker 2", 2.0, 3.0, None, "x"), ("c", 4, "track5", 3.0, 4.0, "no", "x"), (None, 5, "Eva", 1.0, 1.0, "x", "x"), ("c", None, "Eva", 1.0, 1.0, "x", "x")]
    c = transcript.clean_blocks(spark.createDataFrame(rows, BL), spark.createDataFrame([("c", 0, "Eva"), ("c", 5, None)], TR))
    assert [(r.block_no, r.idx, r.label, r.turn_block) for r in c.orderBy("block_no").collect()] == [(1, 0, True, 1), (2, 0, False, 1), (3, 5, False, None), (4, 5, True, 4)]
    assert [(r.speaker, r.text) for r in transcript.turns(c).orderBy("start_ms").collect()] == [("Eva", "ahoj tak jo"), ("Speaker 2", "no")]
    assert transcript.clean_blocks(spark.createDataFrame([], BL), spark.createDataFrame([], TR)).collect() == []


def test_leaks_are_exact(spark):
    rnd = random.Random(2)
    vocab = [f"slovo{i}" for i in range(40)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(30))) for i in range(12)] + [(90, "too short"), (91, None), (92, "")]
    docs = []
    for d in range(60):
        words = [rnd.choice([*vocab, "jine", "x"]) for _ in range(60)]
        n = rnd.choice([11, 12, 13])
        src = rnd.choice(items[:12])[1].split()
        at = rnd.randrange(len(src) - n)
        words[20:20] = [w.upper() if d % 2 else w.replace("o", "ó") for w in src[at : at + n]]
        docs.append((d, (", " if d % 3 else "\n").join(words), "extra"))
    docs += [(100, None, "e"), (101, "", "e"), (102, "a", "e")]
    grams = {}
    for i, t in items[:12]:
        w = leaks.words(t)
        for k in range(len(w) - 11):
            grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    want = {(d, i) for d, t, _ in docs for w in [leaks.words(t)] for k in range(len(w) - 11) for i in grams.get(tuple(w[k : k + 12]), ())}
    df, it = spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, ref_text string")
    got = leaks.leaked(df, it).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and want
    assert leaks.leaked(df.limit(0), it).collect() == [] and leaks.leaked(df, it.limit(0)).collect() == []


def test_near_leaks_against_brute_force(spark):
    """Every passage with every other: no pair may be missing, nor extra, whatever cell it falls in."""
    rnd = random.Random(5)
    vocab = [f"slovo{i}" for i in range(300)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(40))) for i in range(30)]
    docs = []
    for d in range(80):
        src = rnd.choice(items)[1].split()
        at = rnd.randrange(16)
        leak = src[at : at + 24]
        for k in rnd.sample(range(24), d % 4):  # up to three changed words; two may be, and words of no item don't count
            leak[k] = rnd.choice(vocab)
        if d % 5 == 0:
            leak.insert(rnd.randrange(1, 23), "nikde")
        docs.append((d, " ".join([*rnd.choices(vocab, k=20), *leak, *rnd.choices(vocab, k=20)])))
    want, known = {}, {w for _, r in items for w in leaks.words(r)}
    for d, t in docs:
        w = [x for x in leaks.words(t) if x in known]
        for i, r in items:
            v = leaks.words(r)
            for k in range(len(w) - 23):
                own = set(w[k : k + 24])
                if any(sum(x in own for x in v[j : j + 24]) >= 22 and _longest(w[k : k + 24], v[j : j + 24]) >= 22 for j in range(17)):
                    want[d, i] = want.get((d, i), 0) + 1
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, ref_text string")
    for least, recall in ((-1.0, 1.0), (0.98, 0.9)):
        got = {(r.doc_id, r.item_id): r.passages for r in leaks.leaked(df, it, width=24, share=0.9, least_cosine=least, skip_unknown=True).collect()}
        assert set(got) <= set(want) and len(got) >= recall * len(want)
        assert least > 0 or got == want


def _longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_frequencies_of_the_whole_corpus(spark, monkeypatch):
    """A word that is frequent outside of stretches of item words is not rare."""
    import numpy as np

    seen, latent = [], leaks._latent
    monkeypatch.setattr(leaks, "_latent", lambda rows, idf, *more: seen.append(idf) or latent(rows, idf, *more))
    docs = [(i, " ".join(["ano", "jine"] * 9)) for i in range(50)] + [(99, "a b c d e f g h i j k l ano")]  # 18 words: a passage of 12 and one of 6
    got = leaks.leaked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(0, "a b c d e f g h i j k l ano")], "item_id long, ref_text string"))
    assert [(r.doc_id, r.passages) for r in got.collect()] == [(99, 2)]
    assert np.allclose(seen[0], [np.log(103 / 2) + 1] * 12 + [np.log(103 / 102) + 1])


def test_equal_passages_without_vectors():
    import numpy as np

    own = leaks.Items([(0, " ".join("abcdefghijkl"))], 12)
    at, other = leaks.Search(own, np.zeros((12, 4), np.int64), 4, 1 - 1e-9).candidates(np.append(own.passages[0], np.int32(-1)))
    assert at.tolist() == [0] and other.tolist() == [0]


def test_near_leaks_in_parts(monkeypatch):
    import numpy as np

    rnd = random.Random(6)
    own = leaks.Items([(i, " ".join(str(rnd.randrange(50)) for _ in range(40))) for i in range(20)], 12)
    ids = np.concatenate([np.append(np.roll(own.texts[i % 20], i), -1) for i in range(60)]).astype(np.int32)
    near = leaks.Near(own, np.ones((50, 4), np.int64), 0.5, 10)
    whole = near.candidates(ids)
    monkeypatch.setattr(leaks, "PAIRS", 7)
    assert len(whole[0]) and all((a == b).all() for a, b in zip(whole, near.candidates(ids)))


def test_common_subsequence():
    import numpy as np

    assert leaks.common(np.array([1, 2, 3, 4]), np.array([2, 9, 3, 4])) == 3 and leaks.common(np.array([1]), np.array([2])) == 0


NAMES = {"given": {"jiri": ["jiří", "jiri"], "nora": ["nora"]}, "surname": {"novotny": ["novotný", "novotny"], "quarlby": ["quarlby"]}, "ending": {"ecek": []}, "street": {"parade": ["parade"]}, "phone": {"call": ["call"]}}


@pytest.mark.parametrize(
    "text,found",
    [
        ("Pište na jan.novak+x@firma.example.org. Díky", [("email", "jan.novak+x@firma.example.org")]),
        ("jan.novak @ firma.example", [("email", "jan.novak @ firma.example")]),
        ("Kontakt: jan tečka novak zavináč firma tečka example už ne", [("email", "jan tečka novak zavináč firma tečka example")]),
        ("to jan-novak(at)firma(dot)example now", [("email", "jan-novak(at)firma(dot)example")]),
        ("Ping @dispatch in the channel.", []),
        ("Volejte (+420) 105-840-812 po obědě", [("phone", "(+420) 105-840-812")]),
        ("call +44 (0)7700 900082 or 030/23125-94", [("phone", "+44 (0)7700 900082"), ("phone", "030/23125-94")]),
        ("Tel.: plus čtyři dva nula jedna šest dva devět sedm, ano", [("phone", "plus čtyři dva nula jedna šest dva devět sedm")]),
        ("mluvili dva najednou", []),
        ("Rodné číslo 85 11 33 / 3238 ověřeno, Zakázka č. 447972/6337 čeká", [("idnum", "85 11 33 / 3238")]),
        ("ID number 966277567 on file. SSN: 984-44-0882", [("idnum", "966277567"), ("idnum", "984-44-0882")]),
        ("ID number QQ 45 58 01 C on file", [("idnum", "QQ 45 58 01 C")]),
        ("Server 192.0.2.58, verze 2.6138.3, celkem 1 234 2883 v 10:30, 01:12:46", []),
        ("She lives at Flat 3, 143 Fennel Close, Little Quarl.", [("address", "Flat 3, 143 Fennel Close")]),
        ("Bydlí na adrese ul. Pod Kamencem 53a, Mlýnec", [("address", "ul. Pod Kamencem 53a")]),
        ("Er wohnt jetzt Birkenweg 89 b, Altzirkel", [("address", "Birkenweg 89 b")]),
        ("Doručiť na Nad Haťou 58. Doručit na Makovská 3a, Bydlí v ul. Habrová 7", [("address", "Nad Haťou 58"), ("address", "Makovská 3a"), ("address", "ul. Habrová 7")]),
        ("Die Steuernummer L05X64ZZ7 wurde vorgelesen, Steuer-ID 04 855 986 165 bestätigt", [("idnum", "L05X64ZZ7"), ("idnum", "04 855 986 165")]),
        ("Cc: Hruseček, Jiří; the rest", [("name", "Hruseček, Jiří")]),
        ("Sraz v sále 52 v 10:30, Veltora Desk 24", []),
        ("Volal Jiří Novotný, Nora knows best. N. Quarlby sent it, Novotný, Jiří a Nora D. QUARLBY's headset", [("name", "Jiří Novotný"), ("name", "N. Quarlby"), ("name", "Novotný, Jiří"), ("name", "Nora D. QUARLBY")]),
        ("volal jiri novotny kvuli nahravce", [("name", "jiri novotny")]),
        ("Write to john at company dot com or anna dot lee at mail dot example dot org today", [("email", "john at company dot com"), ("email", "anna dot lee at mail dot example dot org")]),
        ("We met at noon. The dot was red at two", []),
        ("Pišt " + "x" * 130 + "@firma.example ano", [("email", "x" * 130 + "@firma.example")]),
        ("to " + "ab dot " * 60 + "z at firma dot example", [("email", "ab dot " * 60 + "z at firma dot example")]),
        ("Bydlí na adrese ul. " + "Dlouhá" * 20 + " 53a, Mlýnec", [("address", "ul. " + "Dlouhá" * 20 + " 53a")]),
        ("She lives at 143 " + "Fennel" * 20 + " Close, Quarl", [("address", "143 " + "Fennel" * 20 + " Close")]),
        ("Moved to 12 Kings Parade, Bath. The parade of 12 long parade", [("address", "12 Kings Parade")]),
        ("Please call 1234567 now, ticket 1234567", [("phone", "1234567")]),
        ("", []),
        (None, []),
    ],
)
def test_personal(text, found):
    got = pii.Finder(NAMES).find(text)
    assert [(k, text[a:z]) for a, z, k in got] == found


def test_decomposed_letters_keep_their_place():
    import unicodedata

    t = unicodedata.normalize("NFD", "Příště volal Jiří Novotný dnes")
    assert [t[a:z] for a, z, _ in pii.Finder(NAMES).find(t)] == [unicodedata.normalize("NFD", "Jiří Novotný")]


def test_names_from_the_corpus(spark):
    rows = [(i, f"**Jiří Novotný** [00:0{i % 10}]\nDobrý den, volal Petr Hruška a Jiří Hruška.\n\n**Petr Hruška** [00:30]\nJiří to ví nejlépe." + " po obědě nikdo nenašel starou mapu" * 9, "x") for i in range(20)] + [(90, None, "x"), (91, "", "x"), (91, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, clean string")
    got = {r.doc_id: (r.clean, [f.found for f in r.found]) for r in pii.find_personal(df).collect()}
    assert got[90] == (None, []) and got[91] == ("", [])
    assert got[3][1] == ["Jiří Novotný", "Petr Hruška", "Jiří Hruška", "Petr Hruška"]
    assert got[3][0].startswith("**[NAME]** [00:03]\nDobrý den, volal [NAME] a [NAME].") and "\nJiří to ví nejlépe. po obědě" in got[3][0]
    assert pii.find_personal(df.limit(0)).collect() == []


def test_rare_names_of_a_large_corpus(spark):
    """One anchor makes a name word, whatever the size of the corpus."""
    counts = [("petr", "petr", 400_000, 300_000, 0), ("hruska", "hruška", 400_000, 0, 299_999), ("vzacny", "vzácný", 1, 0, 1), ("po", "po", 9_000_000, 0, 0)]
    df = spark.createDataFrame(counts, "term string, spelling string, times long, as_first long, as_last long")
    assert {(r.term, r.role) for r in pii.disclosure(df).collect()} == {("petr", "given"), ("hruska", "surname"), ("vzacny", "surname")}


def test_cues_from_the_corpus(spark):
    """Words that stand where streets and phone numbers are certain find those that nothing else tells."""
    rows = [(i, f"She lives at {i} Kings Parade, Bath. Ring +44 7700 90008{i % 10} soon." + " nobody found the old map after lunch" * 9) for i in range(9)] + [(50, "Seen at 7 Queens Parade, then ring 5551234 or order 5551234")]
    got = {r.doc_id: [(f.kind, f.found) for f in r.found] for r in pii.find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[50] == [("address", "7 Queens Parade"), ("phone", "5551234")]


def test_long_lines_take_linear_time():
    import time

    finder, began = pii.Finder(NAMES), time.time()
    for t in ("a@b " * 20_000, "x dot " * 20_000 + "at y", "nora " * 30_000, "adresa " * 20_000, "12 a b road " * 10_000, "x" * 100_000 + "@y.z", "1 2 3 " * 20_000, " at a dot b" * 10_000):
        finder.find(t)
    assert time.time() - began < 60


def test_a_long_list_of_names_is_joined(spark, monkeypatch):
    rows = [(i, f"**Jiří Novotný{i % 7}x** [00:0{i % 10}]\n**Nora Weiß** [00:01]\nvolal Petr Hruška, NORA WEISS's stůl a Jiří Hruška²; Novotný, J.\n**Petr Hruška** [00:30]\nPetr Bezruška i Jiří Malecek." + " po obědě nikdo nenašel starou mapu" * 9) for i in range(20)]
    rows += [(90, None), (91, ""), (92, "nikdo"), (None, rows[3][1]), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(pii.find_personal(df).collect(), key=str)
    monkeypatch.setattr(pii, "LIST_TERMS", 0)
    got = sorted(pii.find_personal(df).collect(), key=str)
    assert got == want and sum(len(r.found) for r in got if r.found) > 60
