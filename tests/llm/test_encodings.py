import random

from lanternq.llm import encodings as E

SCHEMA = "doc_id long, title string, text string, source string"
ZH = ["请各负责人按时提交完整的材料", "图书馆将于本周公布新的名单", "平均得分比去年提高", "由教务处统一核定并及时归还", "关于课程评估的通知", "志愿者可在现场领取表格"]
RU = ["Почему новый отчёт не напечатан в зале", "Сохраните каталог по библиотеки", "точный бланк был проверен"]
FR = ["Le dossier révisé a été complété à la cour", "N’oubliez pas l’échantillon abîmé", "déjà signé, sera ensuite classé"]


def corpus():
    r = random.Random(5)
    rows = []
    for k in range(400):
        lines = {0: ZH, 1: ZH, 2: RU, 3: FR}[k % 4]
        rows.append((k, r.choice(lines), "\n".join(("，" if k % 4 < 2 else ", ").join(r.sample(lines, 2)) + ("。" if k % 4 < 2 else ".") for _ in range(6)), f"s{k % 3}"))
    return rows


def shown(text, true, page):
    return "".join(E.single_table(page)[b] for b in text.encode(true, "ignore")) if page in E.SINGLE else text.encode(true, "ignore").decode(page, "replace")


def test_wrong_pages_are_found_and_restored(spark):
    rows = corpus()
    wrong = {}
    for n, (k, true, page) in enumerate([(0, "utf-8", "cp1252"), (4, "gb18030", "cp1252"), (8, "utf-8", "mac_roman"), (2, "cp1251", "koi8_r"), (6, "koi8_r", "cp1251"), (10, "utf-8", "cp1251"), (3, "utf-8", "cp1252"), (12, "gb18030", "cp949"), (16, "utf-8", "cp437")]):
        i, title, text, s = rows[k]
        lines = text.split("\n")
        at = n % 5 + 1
        wrong[k] = (at + 1, lines[at])
        lines[at] = shown(lines[at], true, page)
        rows[k] = (i, title, "\n".join(lines), s)
    rows[20] = (20, rows[20][1], rows[20][2] + "\n若页面显示“锟斤拷”之类的字样，可到图书馆", "s0")
    rows[21] = (21, rows[21][1], rows[21][2] + "\nThe plaque reads “SÃO TELMO, COMUNICAÇÃO” here", None)
    rows[24] = (24, "��ѯͼ��", rows[24][2], "s0")
    rows += [(900, None, None, None), (901, "", "", "s0")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as field", "2 as gain")
    got = {(r.doc_id, r.field, r.line_no): r.fixed for r in E.wrong_lines(df).collect()}
    assert {k[:2] for k in got} == {(k, "text") for k in wrong} | {(24, "title")}
    whole = [got.get((k, "text", at)) == line for k, (at, line) in wrong.items()]
    assert sum(whole) >= len(whole) - 1
    fixed = {(r.doc_id, r.field): r.fixed for r in E.restored(df, E.wrong_lines(df)).collect()}
    assert fixed[2, "text"] == corpus()[2][2]


def test_one_wrong_word_beside_clean_cyrillic(spark):
    rows = corpus()
    want = {}
    for k in range(2, 400, 40):
        i, title, text, s = rows[k]
        lines = text.split("\n")
        want[i] = lines[2]
        words = lines[2].split(" ")
        words[1] = shown(words[1], "utf-8", "cp1252")
        rows[k] = (i, title, "\n".join([*lines[:2], " ".join(words), *lines[3:]]), s)
    got = {(r.doc_id, r.field, r.line_no): r.fixed for r in E.wrong_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(i, "text", 3): line for i, line in want.items()}


def test_letters_that_are_frequent_by_fault(spark):
    rows = [(i, shown(title, "utf-8", "gb18030"), text, s) if i % 4 == 0 else (i, title, text, s) for i, title, text, s in corpus()]
    want = {i for i, title, _, _ in corpus() if i % 4 == 0}
    assert {r.doc_id for r in E.wrong_lines(spark.createDataFrame(rows, SCHEMA)).filter("field = 'title'").collect()} == want


def test_single_letters_and_short_lines(spark):
    rows = corpus()
    want = {}
    for n, k in enumerate((3, 43, 83)):
        i, title, text, s = rows[k]
        want[i] = "Le café reste signé"
        rows += [(1000 + 20 * n + m, want[i], text, s) for m in range(20)]
        rows[k] = (i, shown(want[i], "utf-8", ("gb18030", "cp949", "cp1251")[n % 3]), text, s)
    rows += [(2000 + n, "名单", ZH[0], "s0") for n in range(20)]
    rows[0] = (0, shown("名单", "gb18030", "cp1252"), rows[0][2], rows[0][3])
    want[0] = "名单"
    got = {(r.doc_id, r.field): r.fixed for r in E.wrong_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(i, "title"): title for i, title in want.items()}


def test_empty(spark):
    assert E.wrong_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_quoted_examples():
    assert E.quoted("显示“Ã©”字样", "显示“é”字样") and not E.quoted("cafÃ© near", "café near")


WORDS = """библиотека каталог читатель студент расписание экзамен преподаватель кафедра отчёт заседание получить новый пропуск
можно только после проверки документов зал открыт ежедневно кроме выходных справка выдаётся деканатом заявление подаётся
лично или через портал срок сдачи работ продлён до конца месяца участники конференции приглашаются стипендия назначается
приказом ректора общежитие занятия начнутся вовремя список литературы опубликован вопросы направляйте секретарю""".split()


def test_a_page_in_no_list_is_learned_from_the_source(spark):
    """Every Cyrillic letter is shown as another sign, by a table made at random: of a whole source among the Cyrillic letters
    themselves, or of half the lines of a third of a source as signs of a Western page."""
    r = random.Random(9)
    letters = [chr(c) for c in range(0x410, 0x450)] + ["ё"]
    for signs, most, first in ((letters, 900, 0), ([chr(c) for c in range(0xA1, 0x100)], 300, 2)):
        table = r.sample(signs, len(letters))
        cipher = str.maketrans(dict(zip(letters, table, strict=True)))
        rows, want = [], {}
        for k in range(900):
            lines = [" ".join(r.choice(WORDS) for _ in range(7)) for _ in range(5)]
            source = f"s{k % 4}"
            if k % 4 == 1 and k < most:
                lines[first:] = [x.translate(cipher) for x in lines[first:]]
                want |= {(k, n): None for n in range(first + 1, 6)}
            rows.append((k, lines[0], "\n".join(lines), source))
        shown_ = {i: t for i, _, t, _ in rows}
        undo = str.maketrans(dict(zip(table, letters, strict=True)))
        want = {(k, n): shown_[k].split("\n")[n - 1].translate(undo) for k, n in want}
        got = {(x.doc_id, x.line_no): x.fixed for x in E.wrong_lines(spark.createDataFrame(rows, SCHEMA)).filter("field = 'text'").collect()}
        assert sum(got.get(at) == line for at, line in want.items()) >= 0.9 * len(want)
        assert len(got.keys() - want.keys()) == 0
