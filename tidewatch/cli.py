"""Command line: replay, diff, compile, explain, rules, console."""

from __future__ import annotations

import argparse
import html
from pathlib import Path

from tidewatch.plans.export import DIALECTS
from tidewatch.plans.rules import Detection, by_id, lint, load_rules, tree


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("tidewatch").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def pick(rules: list[Detection], wanted: str | None) -> Detection:
    found = [d for d in rules if wanted in (None, d.id)]
    if not found:
        raise SystemExit(f"no rule {wanted!r}" if rules else "no rules found")
    return found[0]


def loaded(where: str):
    """A scenario folder, or the name of one that comes with the library."""
    from tidewatch.plans.scenario import Scenario, builtin

    spark = session()
    return Scenario.load(spark, where) if Path(where).is_dir() else builtin(spark)[where]


def shared_rules(old: list[Detection], new: list[Detection], wanted: str | None = None) -> list[tuple[Detection, Detection]]:
    """Rules of one id in both packs, in order of the ids."""
    a, b = by_id(old), by_id(new)
    return [(a[k], b[k]) for k in sorted(a.keys() & b.keys()) if wanted in (None, k)]


def replay(args) -> str:
    from tidewatch.plans.scenario import replay as run

    report = run(loaded(args.scenario), load_rules(args.rules), args.durability)
    return "\n\n".join([report.render(), *[c.render() for c in report.cases if args.explain]])


def diff(args) -> str:
    from tidewatch.operators.lab import rule_diff

    pairs = shared_rules(load_rules(args.old), load_rules(args.new), args.id)
    if not pairs:
        raise SystemExit("no rule id is in both packs")
    events = loaded(args.scenario).events
    return "\n\n".join(rule_diff(events, a, b).render() for a, b in pairs)


def explain(args) -> str:
    from tidewatch.operators.prepare import prepare
    from tidewatch.plans.scenario import case_file

    d, scenario = pick(load_rules(args.rules), args.id), loaded(args.scenario)
    case = case_file(prepare(scenario.events), d, scenario.facts)
    return f"{d.id}: no case, the rule did not fire" if case is None else "\n".join([case.render(), "", "Why this fired:", *[f"  {x}" for x in case.explanation]])


def validate(args) -> str:
    said = [f"{d.id}: [{f.level}] {f.code} — {f.message}" for d in load_rules(args.rules) for f in lint(d)]
    return "\n".join(said) or "no lint findings"


def page(title: str, body: str) -> str:
    return f"<!doctype html><html lang=en><meta charset=utf-8><title>{html.escape(title)}</title><body><h1>{html.escape(title)}</h1>{body}</body></html>"


def console(args) -> str:
    """Writes the investigation console as linked pages: an index, a page for each rule and for each case."""
    from tidewatch.plans.scenario import Scenario, builtin
    from tidewatch.plans.scenario import replay as run

    out, rules, spark = Path(args.out), load_rules(args.rules), session()
    out.mkdir(parents=True, exist_ok=True)
    scenarios = [Scenario.load(spark, p.parent) for p in sorted(Path(args.scenarios).glob("*/scenario.json"))] if args.scenarios else list(builtin(spark).values())
    links = []
    for d in rules:
        said = "\n".join(f"{f.level} {f.code}: {f.message}" for f in lint(d)) or "no lint findings"
        (out / f"rule-{d.id}.html").write_text(page(d.pinned_id, f"<pre>{html.escape(tree(d))}</pre><pre>{html.escape(said)}</pre>" + "".join(f"<h2>{k}</h2><pre>{html.escape(f(d))}</pre>" for k, f in DIALECTS.items())))
        links.append(f"<li><a href='rule-{d.id}.html'>{html.escape(f'{d.pinned_id} [{d.severity}] {d.title}')}</a>")
    for s in scenarios:
        report = run(s, rules, with_durability=False)
        for c in report.cases:
            number = c.row["case_number"]
            (out / f"case-{number}.html").write_text(page(number, f"<pre>{html.escape(c.render())}</pre><pre>{html.escape(chr(10).join(c.explanation))}</pre>"))
            links.append(f"<li><a href='case-{number}.html'>{html.escape(f'{number} ({s.id})')}</a> risk {c.row['risk']}")
    (out / "index.html").write_text(page("Rules and cases", f"<ul>{''.join(links)}</ul>"))
    return f"wrote {out / 'index.html'}"


def version(args) -> str:
    return "tidewatch 0.2"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidewatch")
    subs = top.add_subparsers(required=True)
    default = str(Path(__file__).parent / "plans" / "pack.py")

    def add(to, name, run, *arguments, **options):
        p = to.add_parser(name)
        p.set_defaults(run=run)
        for a in arguments:
            p.add_argument(a)
        for k, v in options.items():
            p.add_argument(f"--{k}", **(v if isinstance(v, dict) else {"default": v}))

    add(subs, "version", version)
    add(subs, "replay", replay, "scenario", rules=default, explain={"action": "store_true"}, durability={"action": argparse.BooleanOptionalAction, "default": True})
    add(subs, "diff", diff, "old", "new", "scenario", id=None)
    add(subs, "compile", lambda a: DIALECTS[a.target](pick(load_rules(a.rules), a.id)), "rules", target={"choices": sorted(DIALECTS), "default": "eql"}, id=None)
    add(subs, "explain", explain, "rules", "scenario", id=None)
    add(subs, "console", console, "out", rules=default, scenarios=None)
    inner = subs.add_parser("rules").add_subparsers(required=True)
    add(inner, "list", lambda a: "\n".join(f"{d.pinned_id}  [{d.severity}]  {d.title}" for d in load_rules(a.rules)), rules=default)
    add(inner, "show", lambda a: tree(pick(load_rules(a.rules), a.id)), rules=default, id=None)
    add(inner, "validate", validate, rules=default)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    print(args.run(args))


if __name__ == "__main__":
    main()
