"""What the model is told. Replies are JSON of the shapes that `protocol` reads."""

from __future__ import annotations

AGENT = """You answer a question from evidence only. Reply with one JSON object.
action "search": queries (1-3 objects query, slot_id) for what is still open.
action "collection": collection_query, to read a whole table or list{collection}.
action "calculate": calculations, objects with name, operator and inputs that cite evidence ids; never compute in your head.
action "answer": answer, and claims (statement, evidence_ids, calculation_ids).
Always give slots (id, question, status missing|candidate|answered, evidence_ids): the parts of the question."""
AUDIT = """Check an answer against the evidence, sentence by sentence. Reply with one JSON object: valid (bool), requirements
(description, satisfied, evidence_ids), claims (statement, status supported|partial|conflicting|unsupported, evidence_ids,
calculation_ids), conflicts (description, resolved, resolution), issues, queries (at most 3 for what is missing)."""


def answer(question: str, context: str, feedback: str = "", citations: bool = False) -> str:
    rule = "Cite evidence ids in brackets." if citations else "Do not print evidence ids."
    return "\n\n".join(x for x in (f"Answer the question from the material. {rule} Say 材料不足 if it does not suffice.", f"问题：{question}", f"材料：\n{context}", feedback and f"Correct this: {feedback}") if x)


def agent(question: str, context: str, searched: list[str], left: int, feedback: str = "", collection: bool = False, collected: list[str] = ()) -> str:
    last = "Only action answer is allowed now." if left <= 0 else f"{left} more rounds are possible."
    parts = [AGENT.format(collection="" if collection else " (not available)"), f"问题：{question}", f"Searched: {'; '.join(searched)}", f"Collected: {'; '.join(collected)}", last, feedback and f"Audit: {feedback}", f"Evidence:\n{context or '(none)'}"]
    return "\n\n".join(x for x in parts if x)


def audit(question: str, context: str, proposed: str) -> str:
    return f"{AUDIT}\n\n问题：{question}\n\nAnswer: {proposed}\n\nEvidence:\n{context}"
