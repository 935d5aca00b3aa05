import random

from marlstone.llm.quality import measure_chunk, merge_chunks, merge_states, statistics

COMMON = ["the", "a", "of", "and", "is", "was", "der", "die", "nicht", "la", "que", "le", "et"]
PROSE = "The index was moved and the cache is a part of it. A reader of the log was slow.\nThe end of the run was quiet, and that is all."
TEXTS = {
    "prose": PROSE, "wrapped": "The index was moved and the cache\nis a part of it, and the end of\nthe run was quiet.", "german": "Der Rechner ist nicht neu und die Daten sind nicht alt.",
    "italian": "Il registro fu aggiornato ieri sera e tutto rimase in ordine per ore.", "japanese": "今日はとても良い天気でしたので、公園まで散歩に行って写真をたくさん撮りました。",
    "list": "The list of the day is here.\n" + "\n".join(f"- open the {w} now" for w in "abcdefgh"), "table": "\n".join("| a | b | c |" for _ in range(9)), "csv": "\n".join("one,2,three,4.5" for _ in range(9)),
    "log": "\n".join(f"2025-01-01T00:00:0{i}Z the end of the run" for i in range(9)), "code": "\n".join("def f(a, b):\n    return [x for x in the if a != 9]" for _ in range(5)),
    "junk": "patch score large opaque hourly isolate\nbuffer folder truncate profile skip", "dots": "....\n....", "empty": "", "blank": " \n\t\n",
}


def test_outcomes(spark):
    rows = [(i, t, 1, "clash") for i, t in enumerate(TEXTS.values())] + [(50, None, 1, ""), (None, PROSE, 1, ""), (0, PROSE, 1, ""), (60, PROSE.replace("\n", " ") * 3000, 1, ""), (61, "x" * 300_000, 1, ""), (61, "x" * 300_000, 1, ""), (62, "y" * 70_000, 1, ""), (62, "z" * 80_000, 1, "")]
    made = statistics(spark.createDataFrame(rows, "k bigint, t string, lines int, state string"), "k", "t", COMMON).collect()
    out = {r.id: r for r in made if r.id != 62}
    assert sorted(r.chars for r in made if r.id == 62) == [70_000, 80_000]
    good = {n for i, n in enumerate(TEXTS) if out[i].is_prose}
    assert good == {"prose", "wrapped", "german", "italian", "japanese"}
    assert out[60].is_prose and not out[61].is_prose and set(out) == {*range(len(TEXTS)), 60, 61}
    assert out[61].chars == 300_000 and out[61].words == 1 and out[0].words == len(PROSE.split()) and out[0].ended_share == 1.0
    assert statistics(spark.createDataFrame([], "k bigint, t string"), "k", "t", COMMON).count() == 0


def test_cuts_do_not_matter():
    rng = random.Random(1)
    common = frozenset(COMMON)
    for text in [*TEXTS.values(), "\n".join(TEXTS.values())]:
        whole = measure_chunk(text, common, True)[0]
        for _ in range(15):
            cuts = sorted(rng.sample(range(len(text) + 1), min(len(text), rng.randrange(0, 6))))
            parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
            assert merge_chunks([measure_chunk(p, common, False) for p in parts], common) == whole


def test_states_merge_in_any_tree():
    rng = random.Random(2)
    common = frozenset(COMMON)
    text = "\n".join(TEXTS.values())
    whole = measure_chunk(text, common, True)[0]
    for _ in range(30):
        cuts = sorted(rng.sample(range(1, len(text)), 9))
        parts = [measure_chunk(text[a:b], common, False) for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        while len(parts) > 1:
            at = rng.randrange(len(parts) - 1)
            parts[at : at + 2] = [merge_states(parts[at : at + 2], common)]
        assert merge_chunks(parts, common) == whole


def test_a_long_text_of_many_chunks(spark):
    text = "\n".join(TEXTS.values()) * 40
    df = spark.createDataFrame([(1, text), (2, "short")], "k bigint, t string")
    whole = {r.id: r for r in statistics(df, "k", "t", COMMON, chunk=10**9).collect()}
    cut = {r.id: r for r in statistics(df, "k", "t", COMMON, chunk=50).collect()}  # some hundred chunks in three levels
    assert cut == whole
