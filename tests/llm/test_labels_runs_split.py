import random
from collections import Counter

import pytest

from confab.llm import split
from confab.llm.labels import Roster
from confab.llm.runs import collapse_runs

EV = "call_id string, seq long, speaker string, start_ms long, end_ms long"
TR = "call_id string, idx int, title string"


def test_labels():
    r = Roster([(1, "Vojtěch Drobtík"), (3, None), (4, "Eva")])
    for label in ("Vojtěch Drobtík", " VOJTĚCH  DROBTÍK:", "vojtech_drobtik", "[Vojtěch Drobtík]", "Vojtěch Drobtík (mic 2)", "Vojtěh Drobtík", "Vojtěch D.", "Drobtík, Vojtěch", "track1", "Speaker 1", "SPEAKER_1", "Vojtěch\xa0Drobtík\xa0"):
        assert r.find(label) == 1, label
    assert r.find("Speaker 2") == 3 and r.find("Speker 2") == 3 and r.find("track-3") == 3 and r.find("Ea") is None and r.find("eva") == 4
    assert r.find("Speaker 9") is None and r.find("") is None and r.find(None) is None and r.find("Nobody") is None
    assert r.key("Nobody") == r.key(" nobody ") < 0


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(small_batches, seed):
    rnd = random.Random(seed)
    calls = ["a"] if seed % 2 else ["a", "b", "c"]
    tracks = [(c, i, rnd.choice(["Ann", "Bo Bi", None, " "])) for c in calls for i in (1, 2)]
    rows = [(rnd.choice(calls), i, "track1" if seed == 3 else rnd.choice(["Ann", "track1", "Speaker 2", "bo_bi", "zz", None]), (s := rnd.randrange(400)), s + rnd.choice([1, 9, 60])) for i in range(80)]
    rows += rows[:10]
    ev = small_batches.createDataFrame(rows, EV)
    got = Counter((r.call_id, r.first_seq, r.last_seq, r.events, r.start_ms, r.end_ms) for r in collapse_runs(ev, small_batches.createDataFrame(tracks + tracks[:1], TR)).collect())
    want = Counter()
    for c in calls:
        roster, cur = Roster([t[1:] for t in tracks if t[0] == c]), []
        for e in [*sorted({r for r in rows if r[0] == c}, key=lambda r: (r[3], r[1])), None]:
            if cur and (e is None or roster.key(e[2]) != roster.key(cur[-1][2])):
                want[c, cur[0][1], cur[-1][1], len(cur), cur[0][3], max(x[4] for x in cur)] += 1
                cur = []
            if e:
                cur.append(e)
    assert got == want


def test_runs_of_nothing_and_nulls(spark):
    ev = spark.createDataFrame([(None, 1, "a", 0, 1), ("c", None, "a", 0, 1), ("c", 1, "a", None, 1), ("c", 2, "a", 5, None)], EV)
    assert [(r.first_seq, r.events) for r in collapse_runs(ev, spark.createDataFrame([], TR)).collect()] == [(2, 1)]
    assert collapse_runs(ev.limit(0), spark.createDataFrame([], TR)).collect() == []


@pytest.mark.parametrize("text,cut", [("a b. " * 400, "sentence"), ("line one\n" * 300, "line"), ("word " * 500, "word"), ("x" * 4000, "none"), ("Ab. " * 300 + "x" * 1700, "none"), ("č" * 1599 + "\r\n" + "d" * 1600, "line")])
def test_pieces(text, cut):
    parts, unit = split.pieces(text)
    assert split.UNITS[unit] == cut
    assert "".join(text[a + over : z] for a, z, over in parts) == text
    assert all(z - a <= 1600 for a, z, _ in parts) and all(0 <= over <= 120 for *_, over in parts) and parts[0][2] == 0
    assert all(parts[i][0] >= parts[i - 1][0] for i in range(1, len(parts)))


def test_pieces_random():
    rnd = random.Random(1)
    for _ in range(60):
        text = "".join(rnd.choice(["a", "bb ", "c. ", "\n", "d", "…", " ", "eeeee"]) for _ in range(rnd.randrange(1, 900)))
        parts, unit = split.pieces(text, 60, 10)
        assert "".join(text[a + o : z] for a, z, o in parts) == text and all(z - a <= 60 and o <= 10 for a, z, o in parts)


def test_split_table(spark):
    df = spark.createDataFrame([("c", 1, "x " * 900, 9), ("c", 1, "x " * 900, 8), ("c", 2, None, 1), ("c", 3, "", 1), (None, 4, "y" * 1700, 1), ("c", 5, "z" * 1600, 1)], "call_id string, block_no int, text string, piece int")
    got = split.split_texts(df, ["call_id", "block_no"]).collect()
    assert {(r.call_id, r.block_no, r.cut, r.n_pieces) for r in got} == {("c", 1, "word", 2), (None, 4, "none", 2)}
    with pytest.raises(ValueError):
        split.split_texts(df, ["call_id"], overlap=900)


def test_units_without_room_for_the_overlap():
    from confab.llm import split

    for size in (1481, 1550, 1599, 1600):
        word = "x" * size
        text = "ano ne " * 100 + word + " " + "tak jo " * 300
        cuts, unit = split.cut_positions(text)
        assert unit == 2 and not any(700 < c < 700 + size for c in cuts)
        parts, _ = split.pieces(text)
        assert all(z - a <= 1600 for a, z, _ in parts) and "".join(text[a + o : z] for a, z, o in parts) == text
        line = ("slovo " * 300)[: size - 1] + "x"
        text = "a\n" * 50 + line + "\n" + "b\n" * 900
        cuts, unit = split.cut_positions(text)
        assert unit == 0 and not any(100 < c < 100 + size for c in cuts)
