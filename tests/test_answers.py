import json

import pytest

from lanternq.operators import calc
from lanternq.operators.evidence import Evidence, Pool, interleaved
from lanternq.rag import protocol
from lanternq.rag.engine import Session, answer_question

CARD = {"title": "T", "url": "http://a.example/1", "content": "共有 3471 人，共 12790 人；甲 乙 丙", "passage_id": "1:0"}
EV = Evidence.of(CARD)


def spec(name, operator, values, **more):
    return {"name": name, "operator": operator, "values": values, "evidence_ids": [EV.evidence_id], **more}


def test_calculations():
    got = calc.run([spec("r", "ratio", [3471, 12790]), spec("n", "count", ["甲", "乙", "丙"]), spec("s", "sort", ["丙", "甲"]), {"name": "d", "operator": "divide", "items": [{"calculation": "n"}, {"value": 3471, "evidence_ids": [EV.evidence_id]}]}], [EV])
    assert [g["result"] for g in got] == [3471 / 12790, 3, ["丙", "甲"] if "丙" < "甲" else ["甲", "丙"], 3 / 3471]
    sets = [{"values": ["甲", "乙"], "evidence_ids": [EV.evidence_id]}, {"values": ["乙", "丙"], "evidence_ids": [EV.evidence_id]}]
    for op, want in (("intersection", ["乙"]), ("union", ["甲", "乙", "丙"]), ("difference", ["甲"]), ("complement", ["甲"])):
        assert calc.run([{"name": op, "operator": op, "sets": sets}], [EV])[0]["result"] == want
    rules = [{"label": "few", "lt": 5000}, {"label": "many", "gte": 5000}]
    assert calc.run([spec("c", "classify", [3471], rules=rules)], [EV])[0]["result"] == "few"


@pytest.mark.parametrize(
    "bad",
    [
        [spec("a", "sum", [987654])],
        [spec("a", "sum", [3471, 3471])],
        [spec("a", "count", ["甲"]), spec("a", "count", ["乙"])],
        [spec("a", "count", ["甲"]), spec("b", "count", ["甲"])],
        [spec("a", "min", [3471, "甲"])],
        [spec("a", "add", [3471])],
        [spec("a", "sum", [True])],
        [spec("a", "classify", [3471], rules=[{"label": "x", "lt": 5000}, {"label": "y", "lt": 6000}])],
        [spec("", "count", ["甲"])],
        [spec("a", "power", [3471])],
        [{"name": "a", "operator": "count", "values": ["甲"], "evidence_ids": ["ev_x"]}],
    ],
)
def test_refused_calculations(bad):
    with pytest.raises(ValueError):
        calc.run(bad, [EV])


def test_pool_and_context():
    pool = Pool()
    cards = [{"title": str(k), "url": "http://u", "content": f"text {k}", "passage_id": str(k)} for k in range(5)] + [{"url": "http://v", "content": "text 0"}, {"url": "w", "content": ""}]
    assert len(pool.add([(c, "q") for c in cards])) == 6 and not pool.add([(cards[0], "q2")])
    assert pool.all()[0].retrieved_by == ("q", "q2")
    text, visible = pool.context([pool.all()[4].evidence_id])
    assert visible[0].text == "text 4" and sum(e.url == "http://u" for e in visible) == 3 and len({e.text for e in visible}) == len(visible)
    pool.pin([pool.all()[1].evidence_id])
    assert pool.context()[1][0].text == "text 1" and pool.context(budget=1) == ("", [])
    assert interleaved([[1, 2, 3], [4], []]) == [1, 4, 2, 3]


def audit(valid=True, **more):
    return json.dumps({"valid": valid, "requirements": [{"description": "d", "satisfied": valid, "evidence_ids": [EV.evidence_id]}], "claims": [{"statement": "3471 of 12790", "status": "supported" if valid else "partial", "evidence_ids": [EV.evidence_id]}], **more})


def scripted(*replies):
    left, asked = list(replies), []

    def model(prompt, json_output=False):
        asked.append(prompt)
        return left.pop(0)

    return model, asked


ANSWER = json.dumps({"action": "answer", "answer": "3471 of 12790", "claims": [{"statement": "3471 of 12790", "evidence_ids": [EV.evidence_id]}]})


def test_simple_answer():
    model, asked = scripted(ANSWER, audit())
    got = answer_question("how many?", lambda q, k: [CARD], model=model)
    assert got["status"] == "answered" and len(asked) == 2 and "trace" not in got and got["sources"][0]["evidence_id"] == EV.evidence_id


def test_search_calculate_collection_answer():
    model, asked = scripted(
        json.dumps({"action": "collection", "collection_query": "名单"}),
        json.dumps({"action": "calculate", "calculations": [spec("r", "ratio", [3471, 12790])]}),
        json.dumps({"action": "search", "queries": [{"query": "more", "slot_id": "a"}], "slots": [{"id": "a", "question": "x"}]}),
        json.dumps({"action": "answer", "answer": "0.27", "claims": [{"statement": "ratio", "evidence_ids": [EV.evidence_id], "calculation_ids": ["计算1"]}]}),
        audit(),
    )
    seen = []
    got = answer_question("share?", lambda q, k: seen.append(q) or [CARD], model=model, collection=lambda q: [CARD | {"passage_id": "t", "content": "名单 丁"}], debug=True)
    assert got["complete"] and seen == ["share?", "more"] and [t["action"] for t in got["trace"]] == ["collection", "calculate", "search", "answer"] and got["model_call_count"] == 5


def test_rejection_leads_to_the_auditors_query_and_partial_answers():
    model, _ = scripted(ANSWER, audit(False, queries=["next"]), ANSWER, audit())
    seen = []
    got = answer_question("q", lambda q, k: seen.append(q) or [CARD], model=model, cycles=2)
    assert seen == ["q", "next"] and got["complete"]
    part = json.dumps({"valid": False, "requirements": [{"description": "a", "satisfied": True}, {"description": "b", "satisfied": False}], "claims": [{"statement": "s。", "status": "supported", "evidence_ids": [EV.evidence_id]}]})
    model, _ = scripted(ANSWER, part, ANSWER, part)
    got = answer_question("q", lambda q, k: [CARD], model=model, cycles=1)
    assert got["status"] == "partial" and got["answer"] == "s；未能回答：b（材料不足）。"
    clash = json.dumps({"valid": False, "requirements": [{"description": "a", "satisfied": True}], "claims": [{"statement": "s", "status": "conflicting", "evidence_ids": [EV.evidence_id]}], "conflicts": [{"description": "x", "resolved": False}]})
    model, _ = scripted(ANSWER, clash, ANSWER, clash)
    assert answer_question("q", lambda q, k: [CARD], model=model, cycles=1)["status"] == "conflicting"


def test_invalid_reply_no_evidence_and_limits():
    model, asked = scripted("no json", "plain answer", audit())
    assert answer_question("q", lambda q, k: [CARD], model=model)["answer"] == "plain answer" and len(asked) == 3
    model, _ = scripted("guess")
    assert answer_question("q", lambda q, k: [], model=model, cycles=1)["answer"] == "guess"
    with pytest.raises(RuntimeError):
        answer_question("q", lambda q, k: [CARD], model=scripted(ANSWER)[0], calls=1)
    for bad in ({"top_k": 0}, {"cycles": 0}):
        with pytest.raises(ValueError):
            Session("q", lambda q, k: [], **bad)
    with pytest.raises(ValueError):
        Session(" ", lambda q, k: [])


@pytest.mark.parametrize("bad", ["[]", "{}", '{"action": "search", "queries": []}', '{"action": "search", "queries": ["a", "b", "c", "d"]}', '{"action": "answer", "answer": ""}', '{"action": "answer", "answer": "x", "slots": [{"id": "a", "question": "q", "status": "odd"}]}'])
def test_protocol_is_strict(bad):
    with pytest.raises(ValueError):
        protocol.decision(bad)


def test_model_needs_its_settings(monkeypatch):
    from lanternq.rag import model, settings

    monkeypatch.delenv(settings.KEY_ENV, raising=False)
    with pytest.raises(RuntimeError):
        model.call_model("x")
    with pytest.raises(ValueError):
        model.call_model(" ")


def test_pieces_without_a_url_are_not_capped():
    from lanternq.operators import evidence

    pool = evidence.Pool()
    pool.add([({"title": f"t{k}", "url": "", "content": f"text {k}", "passage_id": str(k)}, "q") for k in range(6)])
    pool.add([({"title": f"u{k}", "url": "http://a.example/", "content": f"other {k}", "passage_id": f"u{k}"}, "q") for k in range(6)])
    _, visible = pool.context()
    assert sum(not e.url for e in visible) == 6 and sum(bool(e.url) for e in visible) == 3
