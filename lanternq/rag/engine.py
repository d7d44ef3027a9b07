"""The loop: search, let the model act, audit what it claims, and answer within fixed bounds."""

from __future__ import annotations

from collections.abc import Callable

from ..functions.text import normalize
from ..operators import calc
from ..operators.evidence import Evidence, Pool, estimate, interleaved
from . import prompts
from . import settings as S
from .model import call_model
from .protocol import Decision, Slot, decision, known_calculation, verification

Search = Callable[[str, int], list[dict]]


class Session:
    """One question on its way to an answer."""

    def __init__(self, question: str, search: Search, top_k: int = 8, cycles: int = S.CYCLES, calls: int = S.CALLS, model: Callable[..., str] = call_model, collection: Callable[[str], list[dict]] | None = None, citations: bool = False, debug: bool = False) -> None:
        self.question = normalize(question)
        if not self.question:
            raise ValueError("the question is empty")
        for name, value in (("top_k", top_k), ("cycles", cycles), ("calls", calls)):
            if value <= 0:
                raise ValueError(f"{name} must be positive")
        self.search, self.model, self.collection = search, model, collection
        self.top_k, self.cycles, self.most_calls, self.citations = top_k, cycles, calls, citations
        self.pool = Pool()
        self.calculations: list[dict] = []
        self.slots = {"s1": Slot("s1", self.question)}
        self.searched: list[str] = []
        self.collected: list[str] = []
        self.feedback, self.calls = "", 0
        self.trace: list[dict] | None = [] if debug else None

    # ---- the model ----

    def ask(self, prompt: str, json_output: bool = False) -> str:
        if self.calls >= self.most_calls:
            raise RuntimeError("the limit of model calls is reached")
        self.calls += 1
        return self.model(prompt, json_output=json_output)

    def plan(self, new: list[Slot]) -> None:
        """The newest plan holds; evidence of slots that stay is kept."""
        if new:
            old = self.slots
            self.slots = {s.slot_id: Slot(s.slot_id, s.question, s.status, list(dict.fromkeys([*(old[s.slot_id].evidence_ids if s.slot_id in old else []), *s.evidence_ids]))) for s in new}

    def act(self, context: str, left: int) -> Decision:
        return decision(self.ask(prompts.agent(self.question, context, self.searched, left, self.feedback, self.collection is not None, self.collected), True))

    def forced(self, context: str) -> tuple[str, list[dict]]:
        """An answer at any price: from the agent, from its raw reply, or from a plain prompt."""
        reply = self.ask(prompts.agent(self.question, context, self.searched, 0, self.feedback, self.collection is not None, self.collected), True)
        try:
            d = decision(reply)
        except ValueError:
            return " ".join(reply.split()), []
        self.plan(d.slots)
        if d.action == "answer":
            return d.answer, d.claims
        return self.ask(prompts.answer(self.question, context, self.feedback, self.citations)), []

    # ---- evidence ----

    def gather(self, queries: list[str]) -> tuple[str, list[Evidence], dict]:
        new = [q for q in dict.fromkeys(queries) if q not in self.searched]
        batches = []
        for q in new:
            self.searched.append(q)
            batches.append([(card, q) for card in self.search(q, self.top_k)])
        rows = interleaved(batches)
        found = self.pool.add(rows)
        context, visible = self.view([e.evidence_id for e in found])
        seen = [Evidence.of(card, q) for card, q in rows]
        note = {"search_queries": new, "new_results": [{"evidence_id": e.evidence_id, "title": e.title, "url": e.url, "published_at": e.published_at, "preview": e.text[:240]} for e in seen], "evidence_count": len(self.pool.items), "context_evidence_ids": [e.evidence_id for e in visible], "context_chars": len(context), "context_tokens_estimate": estimate(context)}
        return context, visible, note

    def view(self, newest: list[str]) -> tuple[str, list[Evidence]]:
        context, visible = self.pool.context(newest)
        return self.with_calculations(context, visible), visible

    def with_calculations(self, context: str, visible: list[Evidence]) -> str:
        ids = {e.evidence_id for e in visible}
        shown = [c for c in self.calculations if ids.issuperset(c["evidence_ids"])]
        return f"{context}\n\n<计算结果>\n{calc.formatted(shown)}\n</计算结果>" if shown else context

    # ---- the audit ----

    def claims_fault(self, claims: list[dict], visible: list[Evidence]) -> str:
        ids, names = {e.evidence_id for e in visible}, {str(c["name"]) for c in self.calculations}
        for c in claims:
            if not c["evidence_ids"] and not c["calculation_ids"]:
                return "a claim cites nothing"
            if not ids.issuperset(c["evidence_ids"]):
                return "a claim cites evidence outside the context"
            if not all(known_calculation(x, names, len(self.calculations)) for x in c["calculation_ids"]):
                return "a claim cites an unknown calculation"
        return ""

    def audit(self, answer: str, claims: list[dict], context: str, visible: list[Evidence]) -> tuple[bool, str, list[str], dict]:
        fault = self.claims_fault(claims, visible)
        if fault:
            return False, fault, [], {"error": fault}
        cited = {i for c in claims for i in c["evidence_ids"]}
        if cited:  # the auditor sees what the answer cites
            visible = [e for e in visible if e.evidence_id in cited]
            context = self.with_calculations("\n\n".join(e.block(k) for k, e in enumerate(visible, 1)), visible)
        reply = self.ask(prompts.audit(self.question, context, answer), True)
        try:
            return verification(reply, [e.evidence_id for e in visible], {str(c["name"]) for c in self.calculations}, len(self.calculations))
        except ValueError as e:
            return False, f"the audit is invalid: {e}", [], {"error": str(e), "raw": reply}

    # ---- the answer ----

    @staticmethod
    def from_claims(ledger: dict) -> str:
        """The supported statements, and what stays open; nothing if a conflict is unresolved."""
        if any(not c["resolved"] for c in ledger.get("conflicts", [])):
            return ""
        said = list(dict.fromkeys(c["statement"] for c in ledger.get("claims", []) if c["status"] == "supported"))
        if not said:
            return ""
        open_ = list(dict.fromkeys(r["description"] for r in ledger.get("requirements", []) if not r["satisfied"]))
        tail = [f"未能回答：{'、'.join(open_)}（{S.NOT_ENOUGH}）"] if open_ else []
        return "；".join(x.rstrip("。；; ") for x in [*said, *tail]) + "。"

    def finish(self, answer: str, ledger: dict | None = None, claims: list[dict] | None = None) -> dict:
        ledger = ledger or {}
        good = [{k: c[k] for k in ("statement", "evidence_ids", "calculation_ids")} for c in ledger.get("claims", []) if c["status"] == "supported"] or list(claims or [])
        incomplete = any(not r["satisfied"] for r in ledger.get("requirements", [])) or any(c["status"] != "supported" for c in ledger.get("claims", []))
        if any(not c["resolved"] for c in ledger.get("conflicts", [])):
            status = "conflicting"
        elif incomplete:
            status = "partial" if good else "missing"
        else:
            status = "missing" if answer in (S.NOT_ENOUGH, S.NO_RESULTS) else "answered"
        cited = list(dict.fromkeys(i for c in good for i in c["evidence_ids"]))
        slots = [s.public() for s in self.slots.values()]
        if len(slots) == 1 and status == "answered":
            slots[0] |= {"status": "answered", "evidence_ids": cited}
        required = [{"id": f"r{k}", "question": r["description"] or self.question, "depends_on": [], "status": "answered" if r["satisfied"] else "missing", "evidence_ids": r["evidence_ids"]} for k, r in enumerate(ledger.get("requirements", []), 1)]
        out = {
            "answer": answer,
            "status": status,
            "complete": status == "answered",
            "answer_slots": slots,
            "requirements": required or [dict(s) for s in slots],
            "claims": good,
            "sources": [dict(e.result) | {"evidence_id": i} for i in cited if (e := self.pool.get(i))],
            "results": self.pool.results(),
        }
        return out if self.trace is None else out | {"model_call_count": self.calls, "trace": self.trace}

    def settled(self, answer: str, claims: list[dict], ledger: dict) -> dict:
        """A verified answer; one of several requirements is put together from its verified claims."""
        if len(ledger.get("requirements", [])) > 1:
            answer = self.from_claims(ledger) or answer
        return self.finish(answer, ledger, claims)

    def last(self, context: str, visible: list[Evidence], note: dict) -> dict:
        """The final cycle: a forced answer, one revision, then what is supported."""
        if not context:
            answer = self.ask(prompts.answer(self.question, "（没有材料）", self.feedback, self.citations))
            note |= {"action": "fallback_without_evidence", "answer": answer}
            return self.finish(answer)
        ledger: dict = {}
        for turn in range(2):
            answer, claims = self.forced(context)
            valid, self.feedback, _, ledger = self.audit(answer, claims, context, visible)
            note |= {"action": "forced_answer" if not turn else "revised_answer", "answer": answer, "verified": valid, "feedback": self.feedback}
            if valid:
                return self.settled(answer, claims, ledger)
        if "error" in ledger:
            return self.finish(S.NOT_ENOUGH)
        return self.finish(self.from_claims(ledger) or S.NOT_ENOUGH, ledger)

    def run(self) -> dict:
        pending = [self.question]
        for cycle in range(self.cycles):
            context, visible, note = self.gather(pending)
            note["cycle"] = cycle + 1
            if self.trace is not None:
                self.trace.append(note)
            pending = []
            if cycle == self.cycles - 1:
                return self.last(context, visible, note)
            try:
                d = self.act(context, self.cycles - cycle - 1)
            except ValueError as e:
                self.feedback = f"the last reply was invalid: {e}"
                note |= {"action": "invalid", "error": str(e)}
                answer = self.ask(prompts.answer(self.question, context, self.feedback, self.citations)) if context else ""
                d = Decision("answer", answer=" ".join(answer.split())) if answer else None
            if d is None:
                continue
            self.plan(d.slots)
            note.setdefault("action", d.action)
            if d.action == "search":
                pending = d.queries
            elif d.action == "calculate":
                self.calculate(d.calculations, visible, note)
            elif d.action == "collection":
                self.collect(d.collection_query, note)
            else:
                valid, self.feedback, queries, ledger = self.audit(d.answer, d.claims, context, visible)
                note |= {"answer": d.answer, "verified": valid, "feedback": self.feedback}
                if valid:
                    return self.settled(d.answer, d.claims, ledger)
                pending = queries
        raise AssertionError("the last cycle always answers")

    def calculate(self, specs: list[dict], visible: list[Evidence], note: dict) -> None:
        try:
            made = calc.run(specs, visible, self.calculations)
            self.calculations += made
            self.feedback = ""
            note["calculations"] = made
        except ValueError as e:
            self.feedback = f"calculation refused: {e}"
            note["error"] = str(e)

    def collect(self, query: str, note: dict) -> None:
        if self.collection is None or query in self.collected:
            self.feedback = "no collection is available" if self.collection is None else "this collection was read before"
            note["error"] = self.feedback
            return
        self.collected.append(query)
        rows = [(card, query) for card in self.collection(query)]
        self.pool.add(rows)
        self.pool.pin([Evidence.of(card).evidence_id for card, _ in rows])
        self.feedback = "" if rows else "the collection is empty"
        note["collection_results"] = len(rows)


def answer_question(question: str, search: Search, **options) -> dict:
    """The answer to a question with its claims, sources and requirements."""
    return Session(question, search, **options).run()
