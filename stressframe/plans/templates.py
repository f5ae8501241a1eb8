"""Query templates and the job list: named questions with parameters, from Python or YAML."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from fnmatch import fnmatch
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import parts as P
from ..operators import results as R
from ..operators import series as S
from ..operators.contact import contact_metrics
from ..operators.query import Query
from ..operators.select import QUANTITIES, Parts, States, Values


@dataclass
class Template:
    """A question: its parameters with defaults, and what answers it from a table of element states."""

    name: str
    answer: Callable[..., DataFrame]
    category: str
    parameters: dict[str, object] = field(default_factory=dict)

    def run(self, data: DataFrame, **given: object) -> DataFrame:
        unknown = set(given) - set(self.parameters)
        if unknown:
            raise KeyError(f"{self.name} has no parameter {sorted(unknown)[0]}")
        return self.answer(data, **{**self.parameters, **given})


def _history(data: DataFrame, quantity: str) -> DataFrame:
    return P.part_state_statistics(data, [quantity])


def _final(data: DataFrame, quantities: tuple) -> DataFrame:
    return Query(data).states(States.last()).quantities(*quantities).run()


def _critical(data: DataFrame, quantity: str, limit: float) -> DataFrame:
    return Query(data).states(States.all()).quantities(quantity).where(Values.compare(quantity, ">", limit)).run()


def _element(data: DataFrame, element_id: int, quantity: str) -> DataFrame:
    return R.history(Query(data.where(F.col("element_id") == element_id)).states(States.all()).quantities(quantity).run(), quantity)


def _compare(data: DataFrame, part_ids: tuple, quantity: str) -> DataFrame:
    return P.global_extremes(P.part_state_statistics(Parts.by_id(*part_ids).apply(data), [quantity]), quantity)


def _envelope(data: DataFrame, quantity: str) -> DataFrame:
    """By its own name: a group of that name has several quantities."""
    return R.spatial_max(data.withColumn("__q", QUANTITIES[quantity]()), "__q")


TEMPLATES: dict[str, Template] = {
    t.name: t
    for t in (
        Template("max_stress_history", _history, "stress", {"quantity": "von_mises"}),
        Template("max_strain_history", _history, "strain", {"quantity": "effective_plastic_strain"}),
        Template("final_state", _final, "state", {"quantities": ("von_mises", "effective_plastic_strain")}),
        Template("critical_zones", _critical, "stress", {"quantity": "von_mises", "limit": 500.0}),
        Template("element_history", _element, "history", {"element_id": 1, "quantity": "von_mises"}),
        Template("part_comparison", _compare, "stress", {"part_ids": (1, 2), "quantity": "von_mises"}),
        Template("displacement_envelope", _envelope, "motion", {"quantity": "displacement"}),
        Template("energy_balance", S.energy_audit, "energy"),
        Template("contact_force", contact_metrics, "contact"),
        Template("failure", _critical, "strain", {"quantity": "effective_plastic_strain", "limit": 0.3}),
    )
}


def search(pattern: str = "*", category: str | None = None) -> list[str]:
    """Names of templates that match a glob, of a category if one is given."""
    return sorted(n for n, t in TEMPLATES.items() if fnmatch(n, pattern) and category in (None, t.category))


def register(template: Template, *aliases: str) -> None:
    for name in (template.name, *aliases):
        TEMPLATES[name] = template


def save(template: Template) -> str:
    """The template's name, category and parameters as JSON."""
    return json.dumps({"name": template.name, "category": template.category, "parameters": template.parameters}, sort_keys=True)


def load(text: str) -> Template:
    """A template saved before: the registered question of that name, with the saved parameters as defaults."""
    found = json.loads(text)
    known = TEMPLATES[found["name"]]
    return Template(known.name, known.answer, found.get("category", known.category), {**known.parameters, **found["parameters"]})


def load_folder(path: str) -> list[str]:
    """Register every template of a folder's JSON files under the files' names; the names."""
    names = []
    for file in sorted(Path(path).glob("*.json")):
        TEMPLATES[file.stem] = load(file.read_text())
        names.append(file.stem)
    return names


def merged(*configs: dict) -> dict:
    """Settings of several sources, later ones first; sections are merged key by key."""
    out: dict = {}
    for config in configs:
        for k, v in config.items():
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def from_environment(environment: Mapping[str, str], prefix: str = "STRESSFRAME_") -> dict:
    """Settings from variables: PREFIX_A__B=1 is {"a": {"b": 1}}; values are JSON where they can be."""
    out: dict = {}
    for name, value in environment.items():
        if name.startswith(prefix):
            try:
                value = json.loads(value)
            except ValueError:
                pass
            for key in reversed(name[len(prefix) :].lower().split("__")):
                value = {key: value}
            out = merged(out, value)
    return out


def load_jobs(text: str) -> list[dict]:
    """The job list of a YAML or JSON text, checked: each has a type that is known."""
    try:
        config = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("job lists in YAML need the yaml package; JSON always works") from e
        config = yaml.safe_load(text)
    jobs = config["analysis_jobs"] if isinstance(config, dict) else config
    for job in jobs:
        if job.get("type") not in JOBS:
            raise ValueError(f"no job type {job.get('type')!r}")
    return jobs


def _stress(tables: dict[str, DataFrame], job: dict) -> DataFrame:
    data = tables["element_states"]
    data = data.where(F.col("part_id").isin(job["parts"])) if job.get("parts") else data
    return P.part_state_statistics(data, job.get("quantities") or (["von_mises"] if job["type"] == "von_mises" else ["effective_plastic_strain"]))


def _motion(tables: dict[str, DataFrame], job: dict) -> DataFrame:
    return P.motion(tables["node_states"], tables["node_parts"])


def _beams(tables: dict[str, DataFrame], job: dict) -> DataFrame:
    return P.beam_resultants(tables["beam_states"])


def _surface(tables: dict[str, DataFrame], job: dict) -> DataFrame:
    from ..operators import mesh as M

    faces = M.face_geometry(M.with_corners(M.exterior_faces(tables["elements"], job.get("parts")), tables["nodes"]))
    out = None
    for name, direction, degrees in job.get("surfaces") or M.DEFAULT_SURFACES:
        one = M.facing(faces, tuple(direction), degrees).withColumn("surface", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return (M.surface_strain if job["type"] == "surface_strain" else M.surface_stress)(out, tables["element_states"])


def _quality(tables: dict[str, DataFrame], job: dict) -> DataFrame:
    from ..operators import mesh as M

    corners = tables["solid_corners"]
    chosen = M.sampled_states(corners.select("state_idx").distinct(), job.get("states", 10))
    return M.part_quality(M.element_quality(corners.join(chosen, "state_idx", "left_semi")))


def _sets(tables: dict[str, DataFrame], job: dict) -> DataFrame:
    return P.all_set_fields(tables["element_states"], tables["set_members"], job["fields"])


JOBS: dict[str, Callable[[dict[str, DataFrame], dict], DataFrame]] = {"von_mises": _stress, "eff_plastic_strain": _stress, "part_motion": _motion, "beam": _beams, "surface_stress": _surface, "surface_strain": _surface, "element_quality": _quality, "set_report": _sets}


def run_jobs(tables: dict[str, DataFrame], jobs: list[dict]) -> dict[str, DataFrame]:
    """A table for each job. Stress and strain jobs of the same parts become one scan: their quantities are taken together."""
    fused: dict[tuple, list[str]] = {}
    out: dict[str, DataFrame] = {}
    quantity = {"von_mises": "von_mises", "eff_plastic_strain": "effective_plastic_strain"}
    for i, job in enumerate(jobs):
        name = job.get("name", f"job_{i}")
        if job["type"] in quantity and not job.get("quantities"):
            fused.setdefault(tuple(sorted(job.get("parts") or ())), []).append(quantity[job["type"]])
        else:
            out[name] = JOBS[job["type"]](tables, job)
    for parts, quantities in fused.items():
        out["parts_" + ("_".join(map(str, parts)) or "all")] = _stress(tables, {"type": "von_mises", "parts": list(parts), "quantities": list(dict.fromkeys(quantities))})
    return out
