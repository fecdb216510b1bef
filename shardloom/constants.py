"""Values that must be equal wherever the data is produced or read."""

# Token ids.
EOT = 50256
SPECIAL_TOKENS = {
    "<|im_start|>": 50257,
    "<|im_end|>": 50258,
    "<pad>": 50259,
    "<think>": 50260,
    "</think>": 50261,
    "<tool_call>": 50262,
    "</tool_call>": 50263,
    "<tool_result>": 50264,
    "</tool_result>": 50265,
}
IM_START = SPECIAL_TOKENS["<|im_start|>"]
IM_END = SPECIAL_TOKENS["<|im_end|>"]
PAD = SPECIAL_TOKENS["<pad>"]
TOOL_CALL = SPECIAL_TOKENS["<tool_call>"]
END_TOOL_CALL = SPECIAL_TOKENS["</tool_call>"]
TOOL_RESULT = SPECIAL_TOKENS["<tool_result>"]
END_TOOL_RESULT = SPECIAL_TOKENS["</tool_result>"]
TEXT_VOCAB_SIZE = 50257
MAX_ID = 2**16 - 1

# Prompts and sentinel strings.
QA_SYSTEM = "You are a helpful assistant. Answer the question accurately and concisely."
GROUNDED_SYSTEM = (
    "You are a helpful assistant. Answer the question using ONLY the provided context. "
    "If the context does not contain the answer, say that you don't know."
)
TOOL_SYSTEM = "You are a helpful assistant. Use a calculator tool for arithmetic."
ABSTAIN_TEXT = "I don't know."
ABSTAIN_LABEL = "ABSTAIN"
ABSTAIN_MARK = "don't know"

# Defaults of the jobs.
SHARD_SIZE = 100_000_000
SEED = 1337
UNANSWERABLE_FRACTION = 0.20
SUPPORT_CHARS = 400
PREVIEW_CHARS = 180
VALIDATION_BATCHES = 20
STEPS_PER_EPOCH = 5000
WARMUP_FRACTION = 0.03
DECAY_FRACTION = 0.20
TUNING_WARMUP_STEPS = 50
EMA_KEEP = 0.9
MIN_UTIL = 40
STALL_SAMPLES = 6
IDLE_SAMPLES = 10
DIP_UTIL = 80
RECENT_SAMPLES = 60

# Every character that str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
