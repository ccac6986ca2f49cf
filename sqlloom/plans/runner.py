"""Running the steps in order, with a table per step, a checkpoint file, and resume.

``python -m sqlloom.plans.runner --help`` lists the options.
"""

from __future__ import annotations

import argparse
import json
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from sqlloom.operators import dataflow as D
from sqlloom.operators import dedup, steps
from sqlloom.operators.generate import Generator, HttpGenerator
from sqlloom.sources import records

STATUSES = ("pending", "running", "completed", "failed")
from sqlloom.sources.sqlite import Databases


def _listed(text: str) -> list[str]:
    return [p.strip() for p in (text or "").split(",") if p.strip()]


@dataclass
class Config:
    """All settings of a run; ``run_dir`` holds its tables and checkpoint."""

    input_file: str = ""
    output_dir: str = "output"
    run_name: str = "run"
    db_root_path: str = ""
    mode: str = "train"
    mschema_jsonl: str = ""
    template_dir: str = "templates"
    api_urls: str = ""
    model_name: str = ""
    rs_api_urls: str = ""
    rs_model: str = ""
    sampling_count: int = 3
    top_k: int = 2
    indep_rounds: int = 2
    max_workers: int = 32
    verify_workers: int = 64
    compare_workers: int = 20
    batch_size: int = 64
    max_samples: int = 4
    threshold: float = 0.90
    enable_db_inject: bool = False
    inject_budget: int = 10
    inject_attempts: int = 3
    steps: str = ""
    stop_after: str = ""
    force_from: str = ""

    @property
    def run_dir(self) -> str:
        return os.path.join(self.output_dir, self.run_name)

    @property
    def api_url_list(self) -> list[str]:
        return _listed(self.api_urls)

    @property
    def rs_api_url_list(self) -> list[str]:
        return _listed(self.rs_api_urls) or self.api_url_list

    @property
    def rs_model_name(self) -> str:
        return self.rs_model or self.model_name

    @property
    def steps_list(self) -> list[str]:
        return _listed(self.steps)

    def database(self, db_id: str) -> str:
        """The folder or file of a database: one rule for a flat layout, one for a folder of databases a mode."""
        if self.mode.startswith("spider"):
            return os.path.join(self.db_root_path, db_id, f"{db_id}.sqlite")
        return os.path.join(self.db_root_path, f"{self.mode}_databases", db_id, f"{db_id}.sqlite")

    def validate(self) -> list[str]:
        out = [f"{name} is missing" for name in ("input_file", "db_root_path") if not getattr(self, name)]
        known = step_names(self)
        for name in ("stop_after", "force_from"):
            if getattr(self, name) and getattr(self, name) not in known:
                out.append(f"{name}: no step {getattr(self, name)!r}")
        return out + [f"steps: no step {s!r}" for s in self.steps_list if s not in known]

    @classmethod
    def from_arguments(cls, arguments: list[str] | None = None) -> Config:
        parser = argparse.ArgumentParser(description=__doc__)
        for f in fields(cls):
            option = f"--{f.name}"
            if isinstance(f.default, bool):
                parser.add_argument(option, action=argparse.BooleanOptionalAction, default=f.default)
            else:
                parser.add_argument(option, type=type(f.default), default=f.default)
        return cls(**vars(parser.parse_args(arguments)))


def step_names(config: Config) -> list[str]:
    """All steps, in order."""
    def body(p: str) -> list[str]:
        out = [f"{p}_verify", f"{p}_fix"]
        if config.enable_db_inject:
            out.append(f"{p}_inject")
        return [*out, f"{p}_reverify"]

    out = ["breadth_evolve", *body("breadth")]
    for r in range(1, config.indep_rounds + 1):
        out += [f"depth{r}_propose", f"depth{r}_evolve", *body(f"depth{r}")]
    return [*out, "merge", "dedup", "rejection_sampling"]


@dataclass
class Checkpoint:
    """A small JSON file of step statuses, replaced atomically."""

    path: str
    steps: dict[str, str] = field(default_factory=dict)
    current_step: str | None = None

    @classmethod
    def load(cls, path: str) -> Checkpoint:
        out = cls(path)
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                held = json.load(f)
            out.steps, out.current_step = dict(held.get("steps", {})), held.get("current_step")
        return out

    def get(self, step: str) -> str:
        return self.steps.get(step, "pending")

    def set(self, step: str, status: str) -> None:
        if status not in STATUSES:
            raise ValueError(f"no status {status!r}")
        self.steps[step], self.current_step = status, step
        Path(self.path).parent.mkdir(parents=True, exist_ok=True)
        held = {"steps": self.steps, "current_step": self.current_step, "last_updated": time.strftime("%Y-%m-%dT%H:%M:%S")}
        fresh = f"{self.path}.new"
        with open(fresh, "w", encoding="utf-8") as f:
            json.dump(held, f, indent=2)
        os.replace(fresh, self.path)

    def force_from(self, step: str, order: list[str]) -> list[str]:
        """Steps from ``step`` on become pending; their names."""
        again = order[order.index(step) :]
        for s in again:
            self.steps.pop(s, None)
        self.set(step, "pending")
        return again


Step = Callable[["Runner"], DataFrame]


class Runner:
    """Runs the steps of a configuration; every step reads tables that earlier ones wrote and writes one."""

    def __init__(self, spark: SparkSession, config: Config, generator: Generator | None = None, sampler: Generator | None = None, templates: dict[str, str] | None = None, use_db=None):
        self.spark, self.config = spark, config
        self.generator = generator or HttpGenerator(config.api_url_list, config.model_name, threads=config.max_workers)
        self.sampler = sampler or (HttpGenerator(config.rs_api_url_list, config.rs_model_name, threads=config.max_workers) if generator is None else generator)
        self.templates, self.use_db = templates, use_db or Databases(config.database)
        self.order = step_names(config)
        self.checkpoint = Checkpoint.load(os.path.join(config.run_dir, "checkpoint.json"))

    def template(self, name: str) -> str:
        if self.templates is not None:
            return self.templates[name]
        return records.read_text(os.path.join(self.config.template_dir, f"{name}.txt"))

    def path(self, step: str) -> str:
        return os.path.join(self.config.run_dir, step)

    def table(self, step: str) -> DataFrame:
        return self.spark.read.parquet(self.path(step))

    def seeds(self) -> DataFrame:
        return records.read_records(self.spark, self.config.input_file)

    def schemas(self) -> DataFrame | None:
        return records.read_schema_strings(self.spark, self.config.mschema_jsonl) if self.config.mschema_jsonl else None

    def work(self, step: str) -> DataFrame:
        """The frame that a step computes."""
        c = self.config
        part, _, kind = step.partition("_")
        before = self.order[self.order.index(step) - 1] if self.order.index(step) else None
        if step == "breadth_evolve":
            out = steps.evolve_breadth(self.seeds(), self.generator, self.template("breadth"), self.schemas(), c.sampling_count)
            return D.with_row_index(out, "question_id", "evolve_id")
        if kind in ("verify", "reverify"):
            return steps.verify(self.table(before), threads=c.verify_workers, use_db=self.use_db)
        if kind == "fix":
            return steps.fix(self.table(before), self.generator, self.template("fix"), self.schemas(), fix_all=True)
        if kind == "inject":
            return self.table(before)  # injected rows are overlays of the session; see steps.inject
        if kind == "propose":
            r = int(part.removeprefix("depth"))
            return steps.propose_directions(self.table(f"depth{r - 1}_reverify" if r > 1 else "breadth_reverify"), self.generator, self.template("propose"), self.schemas(), c.top_k)
        if kind == "evolve":
            out = steps.evolve_depth(self.table(before), self.generator, self.template("depth"), self.schemas()).drop("row_idx", "proposal", "status", "ex_result")
            return D.with_row_index(out, "question_id", "evolve_id", "direction_id")
        if step == "merge":
            finals = ["breadth_reverify", *(f"depth{r}_reverify" for r in range(1, c.indep_rounds + 1))]
            merged = D.merge_filtered(*(self.table(s).drop("row_idx") for s in finals))
            return D.with_row_index(merged, "question_id", "evolve_id", "direction_id", "question")
        if step == "dedup":
            vectors = dedup.hashed_ngrams(self.table("merge"), "question")
            return dedup.semantic_dedup(vectors, "db_id", "row_idx", "embedding", c.threshold).drop("embedding")
        schemas = self.schemas()
        if schemas is None:
            raise ValueError("rejection_sampling needs mschema_jsonl")
        out = steps.sample_rejections(self.table("dedup"), self.sampler, self.template("sample"), schemas, steps.Sampling(c.max_samples, c.batch_size), use_db=self.use_db)
        return out.where("not _rejected").drop("_rejected", "_reject_reason")

    def run(self) -> list[str]:
        """Run what is to be run; the names of the steps that ran. A failure is recorded and raised."""
        c = self.config
        if wrong := c.validate():
            raise ValueError("; ".join(wrong))
        if c.force_from:
            self.checkpoint.force_from(c.force_from, self.order)
        ran = []
        for step in self.order:
            if not c.steps_list or step in c.steps_list:
                if self.checkpoint.get(step) != "completed":
                    self.checkpoint.set(step, "running")
                    try:
                        self.work(step).write.mode("overwrite").parquet(self.path(step))
                    except Exception:
                        self.checkpoint.set(step, "failed")
                        raise
                    self.checkpoint.set(step, "completed")
                    ran.append(step)
            if step == c.stop_after:
                break
        return ran


def main(arguments: list[str] | None = None) -> None:
    from sqlloom.session import local_session

    config = Config.from_arguments(arguments)
    print("\n".join(Runner(local_session("sqlloom"), config).run()))


if __name__ == "__main__":
    main()
