"""The model-backed embedder with stand-ins for session and tokenizer, batches, warm-up and the command line."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar import cli
from lodestar.functions import embedding
from lodestar.functions.embedding import HashEmbedder, InputTooLong, OnnxEmbedder, fixed_batches
from lodestar.plans.config import EngineConfig
from lodestar.plans.engine import Engine


class Tokenizer:
    """One token a word: its length; 0 pads."""

    def encode(self, text):
        return SimpleNamespace(ids=[len(w) for w in text.split()])

    def token_to_id(self, token):
        return 0 if token == "<pad>" else None


class Session:
    """Hidden state of a token: (id, id squared); counts its batches."""

    def __init__(self, names=("input_ids", "attention_mask"), width=2, fail_over=None):
        self.names, self.width, self.fail_over, self.sizes = names, width, fail_over, []

    def get_inputs(self):
        return [SimpleNamespace(name=n) for n in self.names]

    def run(self, outputs, feed):
        assert set(feed) == set(self.names)
        ids = feed["input_ids"]
        self.sizes.append(len(ids))
        if self.fail_over and len(ids) > self.fail_over:
            raise RuntimeError("out of memory")
        return [np.stack([ids * 1.0, ids**2 * 1.0, ids * 0.0], axis=-1)[:, :, : self.width]]


def embedder_with(monkeypatch, session, **options):
    out = OnnxEmbedder("model", "tokenizer", dim=2, **options)
    monkeypatch.setattr(OnnxEmbedder, "_load", lambda self: (session, Tokenizer()))
    return out


def test_means_over_the_tokens_of_each_text(monkeypatch):
    e = embedder_with(monkeypatch, Session())
    assert e.embed(["a bbb", "cc", ""]) == [[2.0, 5.0], [2.0, 4.0], [0.0, 0.0]] and e.embed([]) == []
    e = embedder_with(monkeypatch, Session(names=("input_ids", "attention_mask", "token_type_ids")))
    assert e.embed(["a"]) == [[1.0, 1.0]]


def test_wrong_outputs_inputs_and_arguments(monkeypatch):
    with pytest.raises(ValueError):
        embedder_with(monkeypatch, Session(width=3)).embed(["a"])
    with pytest.raises(InputTooLong):
        embedder_with(monkeypatch, Session(), max_tokens=1).embed(["a b"])
    for wrong in ({"dim": 0}, {"max_tokens": 0}, {"batch": 0}):
        with pytest.raises(ValueError):
            OnnxEmbedder("m", "t", **wrong)
    monkeypatch.undo()
    with pytest.raises(Exception):
        OnnxEmbedder("no such model", "no such tokenizer").embed(["a"])


def by_batches(e, session, texts):
    """The vectors as the column makes them, without a worker."""
    run = e.column(F.lit("x"))  # the function is made for a column; its plan is what is tested here
    assert run is not None
    sizes = [len(t) for t in texts]
    plan = embedding.length_batches(sizes, e.max_tokens) if e.batch is None else fixed_batches(sizes, e.batch)
    out, near = [None] * len(texts), next(plan)
    try:
        while True:
            try:
                for i, v in zip(near, e._run(session, Tokenizer(), [texts[i] for i in near]), strict=True):
                    out[i] = v.tolist()
                near = plan.send(True)
            except RuntimeError as error:
                if "failed" in str(error):
                    raise
                near = plan.send(False)
    except StopIteration:
        return out


def test_batches(spark, monkeypatch):
    texts = [f"{'x' * (i % 5 + 1)} y" for i in range(40)]
    whole = embedder_with(monkeypatch, Session()).embed(texts)
    session = Session()
    assert by_batches(embedder_with(monkeypatch, session, batch=16), session, texts) == whole and session.sizes == [16, 16, 8]
    session = Session(fail_over=10)
    assert by_batches(embedder_with(monkeypatch, session), session, texts) == whole and max(session.sizes[1:]) <= 40
    session = Session(fail_over=10)
    with pytest.raises(RuntimeError):
        by_batches(embedder_with(monkeypatch, session, batch=16), session, texts)


def test_configuration_and_warm_up(spark, tmp_path):
    fixed = EngineConfig(store_root=f"file://{tmp_path}/s", model_path="m", tokenizer_path="t", embed_auto=False, embed_batch_size=7)
    assert Engine(spark, fixed).embedder.batch == 7
    engine = Engine(spark, EngineConfig(store_root=f"file://{tmp_path}/s", dim=5))
    assert engine.warm_up() == 5 and engine.reconfigure(fixed) and engine.embedder.batch == 7

    class Wrong(HashEmbedder):
        def embed(self, texts):
            return [[0.0]]

    with pytest.raises(ValueError):
        Engine(spark, EngineConfig(store_root=f"file://{tmp_path}/s"), Wrong(dim=3)).warm_up()


def test_command_line(spark, tmp_path, capsys):
    store = f"file://{tmp_path}/store"
    for name in ("a", "b"):
        (tmp_path / f"{name}.txt").write_text(f"text of file {name}")
    assert cli.main(["insert", store, f"file://{tmp_path}/a.txt", f"file://{tmp_path}/b.txt"]) == 0
    assert cli.main(["search", store, "file -b"]) == 0
    assert "a.txt#0" in capsys.readouterr().out
    assert cli.main(["delete", store, "--prefix", f"file:{tmp_path}/a", "--since", "2000-01-01", "--until", "2100"]) == 0
    assert "'db_deleted': 1" in capsys.readouterr().out
    assert cli.main(["delete", store, "--until", "2000"]) == 0
    assert "'db_deleted': 0" in capsys.readouterr().out
    with pytest.raises(ValueError):
        cli.main(["delete", store])
    assert cli.main(["embed", "one", "two", "--dim", "3"]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert [line.split("\t")[:3] for line in lines] == [["one", "hash-1", "3"], ["two", "hash-1", "3"]]
