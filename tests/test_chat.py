import pytest
from pyspark.sql import functions as F

from shardloom.constants import IM_END, IM_START, PAD, SPECIAL_TOKENS
from shardloom.functions.vocab import encoder
from shardloom.operators import chat as c
from shardloom.session import new_scratch_path
from shardloom.sources import chat as src

CHATS = {
    1: [("system", "Be brief."), ("user", "Hello there"), ("assistant", "Hi!"), ("user", "Bye"), ("assistant", "Ciao é")],
    2: [("user", "no answer")],
    3: [("user", "a <tool_call>1+1</tool_call> b <|im_end|>"), ("assistant", "")],
    4: [("assistant", "starts alone " * 30)],
    5: [("user", "word " * 50), ("assistant", "late")],
}


@pytest.fixture(scope="module")
def turns(spark):
    rows = [(k, i * 10, role, text) for k, ts in CHATS.items() for i, (role, text) in enumerate(ts)]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, content string").repartition(5)


def encode(conversation, escape=False):
    """Piece by piece with the library."""
    enc = encoder()
    ids, mask = [], []
    for role, text in conversation:
        learn = int(role == "assistant")
        pieces = [(f"<|im_start|>{role}\n", 0, True), (text, learn, not escape), ("<|im_end|>\n", learn, True)]
        for piece, flag, special in pieces:
            part = enc.encode(piece, allowed_special="all") if special else enc.encode_ordinary(piece)
            ids += part
            mask += [flag] * len(part)
    return ids, mask


@pytest.mark.parametrize("escape", [False, True])
def test_turns_encode_like_the_library(turns, escape):
    got = {}
    for r in c.encode_turns(turns, escape=escape).orderBy("conv_id", "turn").collect():
        ids, mask = got.setdefault(r.conv_id, ([], []))
        ids.extend(r.ids)
        mask.extend(r.mask)
    assert got == {k: encode(ts, escape) for k, ts in CHATS.items()}
    inside = SPECIAL_TOKENS["<tool_call>"] in got[3][0]
    assert inside != escape


def test_rows_encode_like_turns(turns):
    chats = src.turns_to_chat(turns)
    assert all(r["last"] for r in chats.collect())
    got = {r.conv_id: (r.ids, r.mask) for r in c.encode_chats(chats, ["conv_id"]).collect()}
    assert got == {k: encode(ts) for k, ts in CHATS.items()}


@pytest.mark.parametrize("T", [1, 2, 6, 30, 10_000])
def test_assembled_examples(turns, T):
    found = c.min_len(c.assemble_examples(c.encode_turns(turns), T))
    want = {}
    for k, ts in CHATS.items():
        ids, mask = encode(ts)
        if sum(mask) and len(ids[:T]) >= 2:
            want[k] = (ids[:T], mask[:T])
    assert {r.conv_id: (r.ids, r.mask) for r in found.collect()} == want


def test_long_conversations_lose_nothing(turns):
    rows = sorted(src.turns_to_chat(turns, chunk_turns=2).collect(), key=lambda r: (r.conv_id, r.chunk))
    whole = {k: [] for k in CHATS}
    for r in rows:
        assert len(r.messages) <= 2
        whole[r.conv_id] += [(m.role, m.content) for m in r.messages]
    assert whole == CHATS
    assert [r.chunk for r in rows if r.conv_id == 1] == [0, 1, 2]
    assert [(r.conv_id, r.chunk) for r in rows if r["last"]] == [(1, 2), (2, 0), (3, 0), (4, 0), (5, 0)]


def test_empty_roles_fill_the_cut(spark):
    rows = [(1, i, "" if i % 2 else "assistant", "") for i in range(200)] + [(2, 0, "assistant", "x" * 300)]
    examples = c.assemble_examples(c.encode_turns(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, content string"), "char"), 256)
    assert {r.conv_id: (len(r.ids), len(r.mask)) for r in examples.collect()} == {1: (256, 256), 2: (256, 256)}


def test_batches_are_full_and_padded(spark, turns):
    path = new_scratch_path(spark, "test-examples")
    c.min_len(c.assemble_examples(c.encode_turns(turns), 40)).write.parquet(path)
    examples = spark.read.parquet(path)
    rows = c.pad_batch(c.tuning_batches(examples, 3)).orderBy("batch", "row").collect()
    assert [r.conv_id for r in rows] == [1, 3, 4]  # the fourth example has no full batch
    assert len({len(r.ids) for r in rows}) == 1
    ids, mask = encode(CHATS[1])
    n = min(len(ids), 40)
    assert rows[0].ids == ids[:n] + [PAD] * (rows[0].L - n)
    assert rows[0].mask == mask[:n] + [0] * (rows[0].L - n)
    shifted = c.shift_masked(spark.createDataFrame(rows)).orderBy("batch", "row").first()
    assert shifted.x == rows[0].ids[:-1] and shifted.y == rows[0].ids[1:] and shifted.m == rows[0].mask[1:]


def test_masked_mean(spark):
    rows = [(0, [1.0, 2.0, 3.0], [1, 0, 1]), (0, [5.0], [1]), (1, [4.0, 4.0], [0, 0])]
    found = c.masked_mean_loss(spark.createDataFrame(rows, "batch bigint, loss array<double>, m array<int>"))
    assert {r.batch: (r.n_learn, r.loss) for r in found.collect()} == {0: (3, 3.0), 1: (0, 0.0)}


def test_rendering_and_jsonl(spark, turns):
    fits = src.turns_to_chat(turns)
    text = fits.select("conv_id", c.render_chat(F.col("messages"), True).alias("t"))
    want = "<|im_start|>user\nno answer<|im_end|>\n<|im_start|>assistant\n"
    assert {r.conv_id: r.t for r in text.collect()}[2] == want
    path = new_scratch_path(spark, "test-jsonl")
    src.write_chat_jsonl(fits, path)
    back = [[(m.role, m.content) for m in r.messages] for r in src.scan_chat(spark, path).collect()]
    assert sorted(back) == sorted(CHATS.values())
    assert any('"Ciao é"' in r.value for r in spark.read.text(path).collect())


def test_chat_from_one_json_array(spark, tmp_path):
    (tmp_path / "chat.json").write_text('[{"messages":[{"role":"user","content":"a"}],"x":1},{"messages":[]}]')
    rows = src.scan_chat(spark, str(tmp_path / "chat.json"), multi_line=True).collect()
    assert sorted(len(r.messages) for r in rows) == [0, 1]


def test_learnable_filter(turns):
    kept = c.has_learnable(c.encode_turns(turns))
    assert {(r.conv_id, r.role) for r in kept.collect()} == {(1, "assistant"), (3, "assistant"), (4, "assistant"), (5, "assistant")}


def test_special_ids_frame_every_turn(turns):
    for r in c.encode_turns(turns, "char").collect():
        assert r.ids[0] == IM_START and r.ids[-2:] == [IM_END, 10] and len(r.ids) == len(r.mask)


def test_stream_of_batches_crosses_epochs(spark):
    rows = [(i, [i] * (i + 1), [1] * (i + 1)) for i in range(5)]
    path = new_scratch_path(spark, "test-stream")
    spark.createDataFrame(rows, "conv_id bigint, ids array<int>, mask array<int>").write.parquet(path)
    examples = spark.read.parquet(path)
    found = sorted((r.batch, r["row"], r.epoch, r.conv_id, r.L) for r in c.tuning_stream(examples, 3, 4).collect())
    assert [(b, r) for b, r, *_ in found] == [(b, r) for b in range(4) for r in range(3)]
    assert [k for _, _, _, k, _ in found] == [0, 1, 2, 3, 4, 0, 1, 2, 3, 4, 0, 1]
    assert [e for _, _, e, _, _ in found] == [0] * 5 + [1] * 5 + [2] * 2
    assert [length for *_, length in found] == [3] * 3 + [5] * 3 + [4] * 3 + [5] * 3
    with pytest.raises(ValueError, match="no examples"):
        c.tuning_stream(examples.limit(0), 3, 1)


def test_generation_prompt_as_ids(turns):
    plain = c.encode_turns(turns, "char").count()
    encoded = c.encode_turns(turns, "char", add_generation_prompt=True)
    opened = [50257, *map(ord, "assistant\n")]
    prompts = [r for r in encoded.collect() if r.ids == opened]
    assert encoded.count() == plain + len(CHATS)
    assert {r.conv_id for r in prompts} == set(CHATS) and len(prompts) == len(CHATS)
    assert all(r.mask == [0] * len(opened) for r in prompts)


def test_turns_are_encoded_once(spark):
    """Deciding what is learnable, placing and gathering read the written turns, not the encoder."""
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "hello there")], "conv_id long, turn long, role string, content string")
    examples = c.assemble_examples(c.encode_turns(turns), 64)
    assert examples.count() == 1
    plan = examples._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "Python" not in plan
