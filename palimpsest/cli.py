"""Shell of a store, and the failure search, from a terminal: ``python -m palimpsest.cli shell PATH`` or ``sim ...``."""

from __future__ import annotations

import argparse
import cmd
import shlex
import sys

from pyspark.sql import SparkSession

from palimpsest.functions.encodings import format_bytes, parse_bytes
from palimpsest.plans import simulation
from palimpsest.sources.errors import StoreError
from palimpsest.sources.store import Db


class Shell(cmd.Cmd):
    """Commands commit on their own, or act in the transaction named by ``use``."""

    prompt = "> "

    def __init__(self, db: Db, out=sys.stdout) -> None:
        super().__init__(stdout=out)
        self.db, self.txns, self.current = db, {}, None

    def say(self, text: str) -> None:
        print(text, file=self.stdout)

    def onecmd(self, line: str) -> bool:
        head, _, rest = line.strip().partition(" ")
        try:
            return bool(super().onecmd(f"{head.lower()} {rest}".strip()))
        except StoreError as e:
            self.say(f"error: {type(e).__name__}: {e}")
        except (ValueError, IndexError) as e:
            self.say(f"error: {e}")
        return False

    def emptyline(self) -> bool:
        return False

    def default(self, line: str) -> None:
        self.say(f"unknown command: {line.split()[0]}")

    def _within(self, work):
        if self.current:
            return work(self.txns[self.current])
        with self.db.begin() as t:
            got = work(t)
            out = t.commit()
        if out.aborted:
            self.say("aborted")
        return got

    def do_put(self, arg: str) -> None:
        """put KEY VALUE"""
        k, v = map(parse_bytes, shlex.split(arg)[:2])
        if not v:
            raise ValueError("empty value")
        self._within(lambda t: t.put(k, v))
        self.say("ok")

    def do_get(self, arg: str) -> None:
        """get KEY"""
        v = self._within(lambda t: t.get(parse_bytes(shlex.split(arg)[0])))
        self.say("(none)" if v is None else format_bytes(v))

    def do_delete(self, arg: str) -> None:
        """delete KEY"""
        self._within(lambda t: t.delete(parse_bytes(shlex.split(arg)[0])))
        self.say("ok")

    def do_scan(self, arg: str) -> None:
        """scan [START [END]]: keys from START up to but without END"""
        edge = [parse_bytes(x) for x in shlex.split(arg)[:2]] + [None, None]
        rows = self._within(lambda t: list(t.scan(edge[0], edge[1])))
        for k, v in rows:
            self.say(f"{format_bytes(k)} = {format_bytes(v)}")
        self.say(f"{len(rows)} rows")

    def do_begin(self, arg: str) -> None:
        """begin NAME: open a transaction and use it"""
        name = shlex.split(arg)[0]
        if name in self.txns:
            raise ValueError(f"{name} is open")
        self.txns[name], self.current = self.db.begin(), name
        self.say(f"{name} at {self.txns[name].begin_ts}")

    def do_use(self, arg: str) -> None:
        """use [NAME]: act in that transaction, or in none"""
        name = arg.strip() or None
        if name and name not in self.txns:
            raise ValueError(f"no transaction {name}")
        self.current = name

    def do_list(self, _: str) -> None:
        for n, t in sorted(self.txns.items()):
            self.say(f"{'*' if n == self.current else ' '} {n} at {t.begin_ts}")

    def _end(self, arg: str):
        name = arg.strip() or self.current
        if name not in self.txns:
            raise ValueError("no such transaction")
        self.current = None if self.current == name else self.current
        return self.txns.pop(name)

    def do_commit(self, arg: str) -> None:
        """commit [NAME]"""
        out = self._end(arg).commit()
        self.say("aborted" if out.aborted else f"committed at {out.commit_ts}")

    def do_rollback(self, arg: str) -> None:
        """rollback [NAME]"""
        self._end(arg).rollback()
        self.say("rolled back")

    def do_info(self, _: str) -> None:
        self.say(f"path {self.db.path}, {len(self.db._manifest['parts'])} parts, {len(self.db._pending)} versions in memory")

    def do_compact(self, _: str) -> None:
        self.db.compact_all()
        self.say("ok")

    def do_watermark(self, _: str) -> None:
        self.say(str(self.db.gc_watermark()))

    def do_exit(self, _: str) -> bool:
        for t in self.txns.values():
            t.rollback()
        self.txns.clear()
        return True

    do_EOF = do_exit


def main(argv: list[str] | None = None) -> int:
    """0: passed, 1: a failure was found, 2: bad input."""
    p = argparse.ArgumentParser(prog="palimpsest")
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("shell").add_argument("path")
    sim = sub.add_parser("sim").add_subparsers(dest="sim", required=True)
    for name in ("replay", "find-and-shrink", "demo"):
        a = sim.add_parser(name)
        a.add_argument("--seed", type=int, default=1)
        a.add_argument("--count", type=int, default=1 if name == "replay" else 50)
        a.add_argument("--scenario", default="chaos")
        a.add_argument("--bug", default="lost_write" if name == "demo" else "")
    args = p.parse_args(argv)
    if args.what == "sim" and args.scenario not in simulation.SCENARIOS:
        print(f"scenarios: {', '.join(simulation.SCENARIOS)}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("palimpsest").getOrCreate()
    if args.what == "shell":
        with Db.open(spark, args.path) as db:
            Shell(db).cmdloop()
        return 0
    scenario = simulation.replace(simulation.SCENARIOS[args.scenario], bug=args.bug)
    seeds = range(args.seed, args.seed + args.count)
    if args.sim == "replay":
        bad = simulation.find_failures(spark, seeds, [scenario]).collect()
        for r in bad:
            print(f"seed {r.seed}: {r.kind} at op {r.failed_at}: {r.message}")
        return int(bool(bad))
    found = simulation.find_and_shrink(spark, seeds, [scenario], most=3)
    for r in found:
        print(f"seed {r['seed']}: {r['kind']}, {r['ops_before']} -> {r['ops_after']} ops by {' '.join(r['steps'])}: {r['message']}")
    return int(bool(found))


if __name__ == "__main__":
    sys.exit(main())
