from quillmesh.llm import turns


def short(text):
    return [(t[0], t[1], t[3]) for t in turns.turns(text)]


def test_captions_with_voice_tags_out_of_order():
    text = "WEBVTT\n\n00:00:08.000 --> 00:00:10.000\n<v johannes waveri>Second, um... part.\n\n00:00:31.000 --> 00:00:33.000\n<v Waveri, Johannes>Third.\n\n00:00:01.000 --> 00:00:03.000\n<v L. Suhali>First [MUSIC] words.\n"
    assert short(text) == [(1, 1, "First words."), (2, 2, "Second, part. Third.")]


def test_numbered_captions_with_labels():
    text = "1\n00:00:01,050 --> 00:00:03,000\nS1: er The planner.\n\n2\n00:00:09,150 --> 00:00:11,000\nSPEAKER_01: Goes on (coughs).\n\n3\n00:00:16,250 --> 00:00:18,000\nSpk 2: Ummm, uhh.\n\n4\n00:00:19,250 --> 00:00:20,000\nSpeaker 2: Yes.\n"
    assert short(text) == [(1, 1, "The planner. Goes on."), (2, 2, "Yes.")]


def test_running_text_with_time_marks():
    text = "(00:00:05) Speaker 1: One. (00:00:02) speaker2: <noise> (00:00:03) Speaker 2: Zero. (00:00:09) Two."
    assert short(text) == [(1, 1, "Zero."), (2, 2, "One. Two.")]


def test_plain_lines_and_labels_of_one_speaker():
    text = "Zachary  Pasiga : A one.\nZ. Pasiga: A two.\nzachary pasiga: A three.\nZACHARY: A four.\nPasiga, Zachary: A five.\nZachary Pasiga (moderator): A six.\nGabriel Mufipi - B one.\nand it goes on.\nZACHARY: A again."
    assert [(t, s) for t, s, _ in short(text)] == [(1, 1), (2, 2), (3, 1)]
    assert short(text)[1][2] == "B one. and it goes on."


def test_text_with_colons_is_no_label():
    assert short("numbers look off: 3793\nWe said: it is fine, see https://x.example/a") == [(1, 1, "numbers look off: 3793 We said: it is fine, see https://x.example/a")]


def test_lines_without_label_at_the_start():
    assert [(t, s) for t, s, _ in short("[00:01] Something.\n[00:02] Anna: Yes.\n[00:03] ♪ ♪\n[00:04] more")] == [(1, 1), (2, 2)]


def test_notes_and_hesitations():
    assert turns.clean("*applause* Er, hmm... well ((sighs)) then uhm, (inaudible) go ♪ ♪") == "well then go"
    assert turns.clean("Uhh, ummm.") == turns.clean("[door slams]") == turns.clean("♪ la la ♪") == ""
    assert turns.clean("an umbrella for her") == "an umbrella for her"


def test_speech_in_brackets_and_stars_stays():
    assert short("Anna: We shipped it (the new one) today\nAnna: it *really* works [laughs] (coughs)\nBen: (THE END) [see above] yes") == [(1, 1, "We shipped it (the new one) today it really works"), (2, 2, "[see above] yes")]


def test_remarks_are_no_labels():
    assert short("Anna: hi\nBen: hello\nWell - I think so\nAnna: ok") == [(1, 1, "hi"), (2, 2, "hello Well - I think so"), (3, 1, "ok")]
    assert short("Anna: hi\nBen: hello\nNote: bring the keys") == [(1, 1, "hi"), (2, 2, "hello Note: bring the keys")]


def test_bare_times_and_times_behind_labels():
    assert short("00:01:02 Anna: hello\n00:01:01 Ben: first\n00:01:05 - Anna: last") == [(1, 1, "first"), (2, 2, "hello last")]
    assert short("Anna [00:01]: hello\nBen (00:03): hi\nAnna [00:02]: again") == [(1, 1, "hello again"), (2, 2, "hi")]


def test_other_scripts_and_languages():
    assert short("李: 你好\n王: 再见\n李：嗯，好的") == [(1, 1, "你好"), (2, 2, "再见"), (3, 1, "好的")]
    assert short("Sprecher 1: Äh, guten Tag\nSprecher 2: öhm ja (lacht)\nSprecher 2: Hm.") == [(1, 1, "guten Tag"), (2, 2, "ja")]


def test_defined_results():
    assert turns.turns(None) == turns.turns("") == turns.turns(" \n ") == turns.turns("WEBVTT\n\n") == []
    assert short("a" * 200_000) == [(1, 1, "a" * 200_000)]
    assert short("[00:05] A: x\r\n[00:05] B: y\r\n[00:05] A: z") == [(1, 1, "x"), (2, 2, "y"), (3, 1, "z")]


def test_table(spark):
    rows = [("r", '{"transcript_text": "A: one\\nB: two"}'), ("t", '{"full_text": "A: one"}'), ("u", "{broken"), ("v", None), (None, '{"full_text": "A: x"}')]
    got = turns.speaker_turns(turns.transcripts_of(spark.createDataFrame(rows, "rid string, contents string"))).collect()
    assert sorted((r.rid, r.turn_no, r.speaker_no) for r in got) == [("r", 1, 1), ("r", 2, 2), ("t", 1, 1)]
    assert turns.speaker_turns(turns.transcripts_of(spark.createDataFrame([], "rid string, contents string"))).count() == 0
