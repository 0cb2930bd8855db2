import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import chat

TEXT = st.one_of(st.text(), st.lists(st.sampled_from(["<|im_start|>", "<|im_end|>", "<", "\\", "|", "\n", "a", "<\\|", "im_end|>"])).map("".join))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=4))
def test_round_trip(turns):
    rendered = "".join(chat.render_turn(r, t) for r, t in turns)
    assert [(r, t) for r, t, _, _ in chat.parse(rendered)] == turns


@given(st.text(alphabet="abc \n<|\\", max_size=30))
def test_text_without_conflict_stays(text):
    if not chat._CONTROL.search(text):
        assert chat.render_turn("user", text) == f"<|im_start|>user\n{text}<|im_end|>\n"


def test_parser_rejects_what_it_did_not_write():
    for wrong in ["x", "<|im_start|>user\nhi", "<|im_start|>user\nhi<|im_end|>", "<|im_start|>user\n<|im_start|>a\nb<|im_end|>\n"]:
        try:
            chat.parse(wrong)
        except chat.GrammarError:
            continue
        raise AssertionError(wrong)


def test_query_rows(spark):
    rows = [(1, 2, "assistant", "b<|im_end|>", 0), (1, 1, "user", None, 0), (2, 1, None, "x", 0), (2, 1, "assistant", "é", 0), (2, 1, "assistant", "é", 0), (None, None, "assistant", "", 0), (3, 1, "as\nsistant\\n", "<\\|" * 3, 0)]
    rows += [(4, k, "assistant" if k % 2 else "user", f"turn {k} " * 50, 0) for k in range(3000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, segment int").repartition(3)
    both = frame.drop("segment").unionByName(chat.probe(spark, frame))
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(both)).collect()}
    rows += [(-1, 0, "user", chat.PROBE_TEXT, 0), (-1, 1, "assistant", chat.PROBE_TEXT, 0)]
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        turns = sorted(((t if t is not None else -1, ro or "", te or "") for c, t, ro, te, _ in rows if c == conv))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        loss = "".join(te for _, ro, te in turns if ro == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == sha("".join(f"{ro}\n{te}\n" for _, ro, te in turns))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        assert r.formatted_chars == sum(len(chat.render_turn(ro, te)) for _, ro, te in turns)


@given(st.lists(st.tuples(TEXT, TEXT), max_size=4), st.integers(1, 40))
def test_pieces_of_any_size_read_alike(turns, size):
    whole = "".join(chat.render_turn(r, t) for r, t in turns)
    reader = chat.Reader()
    got = [t for k in range(0, len(whole), size) for t in reader.feed(whole[k : k + size])]
    assert reader.close() == len(whole) and got == chat.parse(whole)
    assert [chat.unescape(whole[a:b]) for _, _, a, b in got] == [t for _, t in turns]


def test_loss_mask_cuts_the_texts_out_of_the_output(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"é {c} <|im_end|> {t}" if t % 3 else None) for c in range(7) for t in range(9)]
    segments = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3))
    whole = {}
    for r in sorted(segments.collect(), key=lambda r: (r.conv_id, r.turn)):
        whole[r.conv_id] = whole.get(r.conv_id, "") + r.segment
    got = sorted((r.conv_id, r.begin, chat.unescape(whole[r.conv_id][r.begin : r.end])) for r in chat.loss_mask(segments).collect())
    assert [(c, t) for c, _, t in got] == [(c, t or "") for c, n, _, t in rows if n % 2]


def test_extra_columns_and_empty(spark):
    frame = spark.createDataFrame([], "conv_id long, turn int, role string, text string, segment string, n_turns int")
    assert chat.read_back(chat.formatted(frame)).collect() == []
