"""Where external models plug in: functions over batches of rows with a fixed schema, failures as rows."""

from __future__ import annotations

import multiprocessing
import queue
import traceback
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

# The contracts of what is not part of this engine: input columns and output columns.
CONTRACTS = {
    "audio": ("video_id, path", "video_id string, audio binary"),  # mono, 16 kHz
    "speech": ("video_id, audio binary", "video_id string, start double, end double, text string, speaker string"),
    "scene_cuts": ("video_id, path", "video_id string, start double, end double"),
    "motion": ("video_id, path", "video_id string, at double, magnitude double"),
    "loudness": ("video_id, audio binary", "video_id string, at double, db double"),
    "clips": ("video_id, scene_id, path, start, end", "video_id string, scene_id int, clip_path string"),
    "vision": ("video_id, scene_id, clip_path, transcript", "video_id string, scene_id int, visual_description string, mood string, lighting string, background string"),
    "captions": ("video_id, scene_id, prompt", "video_id string, scene_id int, caption string"),
    "sounds": ("video_id, scene_id, clip_path", "video_id string, scene_id int, audio_tags array<string>, audio_vibes array<string>"),
    "embedding": ("video_id, scene_id, text, clip_path", "video_id string, scene_id int, embedding array<float>"),
    "discourse": ("video_id, edu_strings", "video_id string, tree string"),
    "parser": ("video_id, text", "video_id string, xml string"),
    "concepts": ("concept_id, prompt", "concept_id string, summary string, visual_style string, audio_style string, storyline string, keywords array<string>"),
    "verdict": ("video_id, messages", "video_id string, raw_llm_output string"),
    "tokens": ("key, text", "key string, n_tokens int"),
    "graph": ("video_id, captions", "video_id string, src string, tgt string, rel string"),
    "download": ("video_id, video_link", "video_id string, path string"),
    "search": ("video_id, edges", "video_id string, scene_ids array<int>, reward double"),  # the kept scenes of a tree search over subgraphs
    "shapley": ("video_id, scene_ids", "video_id string, scene_id int, value double"),
}


def _child(model: Callable, inbox, outbox) -> None:
    while (part := inbox.get()) is not None:
        try:
            outbox.put(("ok", model(part)))
        except Exception:  # noqa: BLE001
            outbox.put(("error", traceback.format_exc(limit=1)))


class Isolated:
    """A model in a process of its own, which is started again after a crash or when a call takes more than ``limit`` seconds."""

    def __init__(self, model: Callable[[pd.DataFrame], pd.DataFrame], limit: float) -> None:
        self.model, self.limit, self.process = model, limit, None

    def _start(self) -> None:
        ctx = multiprocessing.get_context("fork")
        self.inbox, self.outbox = ctx.Queue(), ctx.Queue()
        self.process = ctx.Process(target=_child, args=(self.model, self.inbox, self.outbox), daemon=True)
        self.process.start()

    def __call__(self, part: pd.DataFrame) -> tuple[str, object]:
        """(status, result): ok with rows, error with a message, crashed or timeout."""
        if self.process is None or not self.process.is_alive():
            self._start()
        self.inbox.put(part)
        waited = 0.0
        while waited < self.limit:
            try:
                return self.outbox.get(timeout=min(0.2, self.limit))
            except queue.Empty:
                waited += min(0.2, self.limit)
                if not self.process.is_alive():
                    try:  # it may have answered before it ended
                        return self.outbox.get(timeout=0.2)
                    except queue.Empty:
                        return "crashed", f"the process ended with code {self.process.exitcode}"
        self.close()
        return "timeout", f"no answer within {self.limit} s"

    def close(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.join()
            self.process = None


def apply_model(
    df: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], key: str, schema: str, batch: int = 64, limit: float | None = None, retries: int = 0, accept: Callable[[pd.DataFrame], bool] | None = None
) -> DataFrame:
    """Rows of ``schema`` and (status, error): ``model`` on batches of rows; where a batch fails its rows are tried one by one.

    ``schema`` has the key first. A failing row gives its key, a status and the message; the task goes on. With
    ``limit`` the model runs in a process of its own, so that a crash or a call of more than ``limit`` seconds costs only
    the rows it was at (status crashed or timeout). ``accept`` judges an answer; one that it refuses counts as failed,
    and a row is tried ``retries`` times more.
    """
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Isolated(model, limit) if limit else None

        def once(part: pd.DataFrame) -> tuple[str, object]:
            if held:
                status, out = held(part)
            else:
                try:
                    status, out = "ok", model(part)
                except Exception:  # noqa: BLE001
                    status, out = "error", traceback.format_exc(limit=1)
            return ("error", "the answer was refused") if status == "ok" and accept is not None and not accept(out) else (status, out)

        try:
            for pdf in it:
                for a in range(0, len(pdf), batch):
                    part = pdf.iloc[a : a + batch]
                    status, out = once(part)
                    if status == "ok":
                        yield out[names].assign(status="ok", error=None)
                        continue
                    for i in range(len(part)):
                        one = part.iloc[i : i + 1]
                        for _ in range(1 + retries):
                            status, out = once(one)
                            if status == "ok":
                                break
                        if status == "ok":
                            yield out[names].assign(status="ok", error=None)
                        else:
                            bad = {n: [None] for n in names} | {key: [one[key].iloc[0]]}
                            yield pd.DataFrame(bad | {"status": [status], "error": [out]})
        finally:
            if held:
                held.close()

    return df.mapInPandas(run, f"{schema}, status string, error string")


def long_enough(column: str, least: int = 10) -> Callable[[pd.DataFrame], bool]:
    """Accepts an answer whose texts in ``column`` all have more than ``least`` characters."""
    return lambda out: bool(out[column].fillna("").str.len().gt(least).all())


def narrate(df: DataFrame, model: Callable[[str, list[str]], tuple[list[str], str]], group: str, order: str, text: str, batch: int = 10) -> DataFrame:
    """(group, order, caption): texts in batches of ten in order, each batch with the summary that ``model(summary, texts)`` gave of those before.

    The summary makes the batches of a group depend on each other, so a group's rows are worked off by one task, in
    order; they come sorted and in batches (the group is a partition key, not one frame), so a large one is not held at once.
    """
    g, o = (df.schema[c].dataType.simpleString() for c in (group, order))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, summary, waiting = object(), "", []

        def told(rows: list[tuple]) -> tuple[pd.DataFrame, str]:
            said, new = model(summary, [t for _, _, t in rows])
            return pd.DataFrame({group: [r[0] for r in rows], order: [r[1] for r in rows], "caption": said}), new

        for pdf in it:
            for row in zip(pdf[group], pdf[order], pdf[text]):
                if waiting and (row[0] != at or len(waiting) == batch):
                    out, summary = told(waiting)
                    yield out
                    waiting = []
                if row[0] != at:
                    at, summary = row[0], ""
                waiting.append(row)
        if waiting:
            yield told(waiting)[0]

    rows = df.select(group, order, text)
    return rows.repartition(group).sortWithinPartitions(group, order).mapInPandas(run, f"{group} {g}, {order} {o}, caption string")
