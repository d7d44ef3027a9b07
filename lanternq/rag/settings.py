"""Fixed values of the loop; the model's address comes from the environment."""

CYCLES, QUERIES, RESULTS, CHUNKS_PER_URL, CALLS = 5, 3, 20, 3, 12
TIMEOUT_SECONDS, OUTPUT_TOKENS = 55.0, 8192
KEY_ENV, URL_ENV, MODEL_ENV = "LANTERNQ_LLM_KEY", "LANTERNQ_LLM_URL", "LANTERNQ_LLM_MODEL"
NO_RESULTS, NOT_ENOUGH = "未检索到相关信息", "材料不足"
SLOT_STATES = ("missing", "candidate", "answered")
CLAIM_STATES = ("supported", "partial", "conflicting", "unsupported")
