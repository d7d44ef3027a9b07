import pytest

from lanternq.llm import sentences as S

CASES = {
    "zh": "关于题库，系主任只说了一句：“学院还在采集……”|平均得分为5.41分，更加常规。|“这份名单是否最终？由谁分析？”负责老师问道。|编号为No.67.|截至2022.1.6，已为5人办理（详见附件3。附件以最新为准）。|谁来打印它？！|登录http://a.example/p/1.htm查看。",
    "zh2": "原本部分，才有了今天的学院……|“先核对编号！”访问学者提醒大家。\n附件2. 关于领取的通知.xlsx\n\n　三、标题",
    "en": "Dr. J. K. Hesk said, “It will be done soon.”|See No. 165 of vol. 30, e.g. the first vs. the Second one!|“Has it been sorted?” asked Ms. Ard.|It opens at five p.m.|eNote 3.1 replaces it...|Each is read, then ... after a pause ... sent (see Fig. 6. and 7.) again.",
    "de": "„Ist es schon verschoben?“, fragte Prof. Stein.|Etwa 7,7 Prozent, d. h. ca. 4 Stück, wurden am 8. Oktober 2019 geprüft, z. B. Holz.",
    "fr": "Où est le carnet de M. Ther ?|« Est-il complet ? » demanda Mme Ouldrin.|N’oubliez pas, cf. p. 3 !",
    "ru": "«Разве готов?» — спросил проф. Мешк.|В 2025 г. отчёт, т. е. 3 шт., утерян.|Проф. Вель сообщил.",
    "ja": "「手引きはもう提出しましたか。」と教授が尋ねた。|忘れずに提出しましょう！",
    "th": "กรุณาส่งรัตลานก่อน |อาจารย์ชัยสุขมีคะแนน8.31คะแนน",
    "hi": "“कब जाँच होगी?” डॉ. दीप ने पूछा।|क्या समय पर हुई?",
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    marked = CASES[name]
    text, want = "", []
    for line in marked.split("\n"):
        for part in line.split("|"):
            joint = "" if name in ("zh", "zh2", "ja", "th") or text.endswith("\n") or not text else " "
            text += joint + part
            if part.strip():
                want.append(part.strip().strip("　"))
        text += "\n"
    got = S.sentences(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("sentence_no").collect()
    assert [r.sentence for r in got] == want
    assert all(text[r.start_pos : r.end_pos] == r.sentence for r in got)


def test_positions_hold_beyond_the_basic_plane_and_at_the_edges(spark):
    text = "\U0001f3eb一。二。 \n\n x "
    rows = [(1, text), (1, text), (2, None), (3, ""), (4, " \n　"), (None, "a。" * 5000)]
    got = S.sentences(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as sentence_no", "2 as start_pos")).collect()
    one = sorted((r.start_pos, r.end_pos) for r in got if r.doc_id == 1)
    assert one == [(0, 3), (0, 3), (3, 6), (3, 6), (10, 11), (10, 11)]
    assert sum(r.doc_id is None for r in got) == 5000 and {r.doc_id for r in got} == {1, None}


def test_quotes_and_brackets_of_any_length_hold_together(spark):
    long = "一二三。" * 2000
    text = f"他说：“{long}”\n（{long}）之后。再来。\n“a「{long}」b。”c"
    got = [(r.start_pos, r.sentence) for r in S.sentences(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("sentence_no").collect()]
    assert [x for _, x in got] == [f"他说：“{long}”", f"（{long}）之后。", "再来。", f"“a「{long}」b。”c"]
    assert all(text[a : a + len(x)] == x for a, x in got)


def test_nothing_is_shuffled(spark):
    plan = S.sentences(spark.range(4).selectExpr("id as doc_id", "'a. B.' as text"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
