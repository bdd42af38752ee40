"""Execution facts: screen a function, make inputs for it, run it in a child process, read the traces.

Nothing is ever run in the executor's own process. A child Python (isolated mode, CPU, memory and file
limits, few built-ins, a time limit per call and a limit of traced events) runs a whole batch twice; what
differs between the runs is no fact. A batch that dies is halved until the function at fault is alone.
"""

from __future__ import annotations

import ast
import json
import subprocess
import sys

from .pysource import BUILTINS, FUNCTIONS, ParseFailure, docstring_of, parsed, repaired

# What a screened function may use.
MODULES = ("math", "re", "json", "itertools", "functools", "collections", "string", "datetime", "random")
BANNED = frozenset("open exec eval compile input __import__ globals locals vars getattr setattr delattr breakpoint exit quit help memoryview".split())
CPU_S, MEMORY_MB, CALL_S, EVENTS, BATCH_S = 10, 512, 2, 200_000, 30
VALUES = {  # Fixed values: inputs by kind; the last is the empty one, if a kind has it
    "int": ([0, 3, 7], None), "float": ([0.5, 2.0, -1.5], None), "str": (["abc", "Hello World", "a,b"], ""), "bool": ([True, False], None),
    "list": ([[1, 2, 3], [5], ["a", "b"]], []), "dict": ([{"a": 1}, {"x": 2, "y": 3}], {}), "tuple": ([(1, 2), (3,)], ()), "set": ([{1, 2}], set()),
}
HINTS = {  # Fixed values: kinds that names suggest
    "int": ("n", "i", "k", "count", "size", "num", "index", "limit", "x", "y", "a", "b"), "str": ("s", "text", "name", "string", "line", "word", "key", "path"),
    "list": ("items", "values", "lst", "arr", "xs", "rows", "seq", "data", "numbers"), "dict": ("d", "mapping", "config", "options"), "bool": ("flag", "verbose", "strict"),
}


def screen(code: str) -> tuple[ast.FunctionDef | None, str | None]:
    """The function if it is self-contained, else the first reason why not."""
    try:
        text, _, tree = parsed(code)
    except ParseFailure:
        return None, "parse"
    node = next((n for n in tree.body if isinstance(n, FUNCTIONS)), None)
    if node is None:
        return None, "parse"
    nodes = list(ast.walk(node))
    params = {a.arg for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs)}
    bound = params | {n.id for n in nodes if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)} | {n.arg for n in nodes if isinstance(n, ast.arg)} | {n.name for n in nodes if isinstance(n, (*FUNCTIONS, ast.ClassDef))}
    bound |= {n.name for n in nodes if isinstance(n, ast.ExceptHandler) and n.name}
    names = {n.id for n in nodes if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load)}
    roots = {n.value.id for n in nodes if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name)}
    called = {n.func.id for n in nodes if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)}
    checks = (
        ("async", isinstance(node, ast.AsyncFunctionDef) or any(isinstance(n, ast.Await) for n in nodes)), ("too_long", len(text) > 6_000), ("decorated", bool(node.decorator_list)),
        ("generator", any(isinstance(n, (ast.Yield, ast.YieldFrom)) for n in nodes)), ("global", any(isinstance(n, (ast.Global, ast.Nonlocal)) for n in nodes)),
        ("import", any(isinstance(n, (ast.Import, ast.ImportFrom)) for n in nodes)), ("dunder", any(isinstance(n, ast.Attribute) and n.attr.startswith("__") for n in nodes) or any(x.startswith("__") for x in names)),
        ("attr_on_global", bool(roots - bound - set(MODULES) - BUILTINS)), ("forbidden", bool(names & BANNED)), ("free_var", bool(names - bound - BUILTINS - set(MODULES))),
        ("param_called", bool(called & params)), ("self", bool(params & {"self", "cls"})),
    )
    reason = next((r for r, bad in checks if bad), None)
    return (None, reason) if reason else (node, None)


def kind_of(node: ast.FunctionDef, arg: ast.arg, default: ast.expr | None) -> tuple[str, bool]:
    """A parameter's kind, and whether annotation, default or use grounds it; else its name guesses."""
    if arg.annotation is not None:
        text = ast.unparse(arg.annotation).lower()
        for k in VALUES:
            if text.split("[")[0].split(".")[-1] == k:
                return k, True
    if isinstance(default, ast.Constant) and type(default.value).__name__ in VALUES:
        return type(default.value).__name__, True
    for n in ast.walk(node):
        own = lambda x: isinstance(x, ast.Name) and x.id == arg.arg
        if isinstance(n, ast.For) and own(n.iter):
            return "list", True
        if isinstance(n, ast.Attribute) and own(n.value):
            for k, methods in (("str", ("upper", "lower", "split", "strip", "replace", "join", "startswith")), ("dict", ("items", "keys", "get")), ("list", ("append", "extend", "sort", "pop"))):
                if n.attr in methods:
                    return k, True
        if isinstance(n, ast.BinOp) and (own(n.left) or own(n.right)):
            other = n.right if own(n.left) else n.left
            if isinstance(other, ast.Constant) and type(other.value).__name__ in VALUES:
                return type(other.value).__name__, True
    for k, hints in HINTS.items():
        if arg.arg in hints:
            return k, False
    return "int", False


def inputs(node: ast.FunctionDef) -> list[dict]:
    """Up to six combinations of arguments and one with an empty first sequence."""
    args = node.args
    late = dict(zip(reversed([a.arg for a in (*args.posonlyargs, *args.args)]), reversed(args.defaults)))
    late |= {a.arg: d for a, d in zip(args.kwonlyargs, args.kw_defaults) if d is not None}
    every = [*args.posonlyargs, *args.args, *args.kwonlyargs]
    kinds = [kind_of(node, a, late.get(a.arg)) for a in every]
    grounded = all(g for _, g in kinds)
    only = {a.arg for a in args.kwonlyargs}

    def call(values: list, empty: str | None = None) -> dict:
        pairs = list(zip(every, values))
        return {"args": [repr(v) for a, v in pairs if a.arg not in only], "kwargs": {a.arg: repr(v) for a, v in pairs if a.arg in only}, "empty": empty, "typed": grounded}

    width = max((len(VALUES[k][0]) for k, _ in kinds), default=1)
    out = [call([VALUES[k][0][(i + j) % len(VALUES[k][0])] for j, (k, _) in enumerate(kinds)]) for i in range(min(6, width if kinds else 1))]
    for j, (k, _) in enumerate(kinds):
        if VALUES[k][1] is not None:
            out.append(call([VALUES[x][1] if i == j else VALUES[x][0][0] for i, (x, _) in enumerate(kinds)], every[j].arg))
            break
    return out


_CHILD = r'''
import ast, builtins, collections, datetime, functools, itertools, json, math, random, re, resource, signal, string, sys
cfg = json.load(sys.stdin)
resource.setrlimit(resource.RLIMIT_CPU, (cfg["cpu"], cfg["cpu"]))
resource.setrlimit(resource.RLIMIT_AS, (cfg["memory"] << 20, cfg["memory"] << 20))
resource.setrlimit(resource.RLIMIT_FSIZE, (0, 0))
resource.setrlimit(resource.RLIMIT_NPROC, (0, 0))
safe = {k: getattr(builtins, k) for k in dir(builtins) if k not in cfg["banned"] and not k.startswith("__")}
class Late(BaseException): pass
def alarm(*_): raise Late()
signal.signal(signal.SIGALRM, alarm)
def plain(v, depth=0):
    if depth > 4: return None
    if v is None or isinstance(v, (bool, int, str)): return repr(v)
    if isinstance(v, float): return repr(v) if v == v and abs(v) != float("inf") else None
    if isinstance(v, (list, tuple)):
        parts = [plain(x, depth + 1) for x in v]
        return None if None in parts else ("[" + ", ".join(parts) + "]" if isinstance(v, list) else "(" + ", ".join(parts) + ("," if len(parts) == 1 else "") + ")")
    if isinstance(v, (set, frozenset)):
        parts = [plain(x, depth + 1) for x in v]
        return None if None in parts else ("{" + ", ".join(sorted(parts)) + "}" if parts else "set()")
    if isinstance(v, dict):
        parts = [(plain(a, depth + 1), plain(b, depth + 1)) for a, b in v.items()]
        return None if any(None in p for p in parts) else "{" + ", ".join(a + ": " + b for a, b in parts) + "}"
    return None
def short(v):
    text = plain(v)
    return text if text is not None and len(text) <= 120 else None
def one(code, name, call):
    space = {"__builtins__": safe, **{m: sys.modules[m] for m in cfg["modules"]}}
    counts, snaps, events = {}, {}, 0
    def trace(frame, event, arg):
        nonlocal events
        if frame.f_code.co_filename != "<fn>": return None
        events += 1
        if events > cfg["events"]: raise Late()
        if event == "line" and frame.f_code.co_name == name:
            counts[frame.f_lineno] = counts.get(frame.f_lineno, 0) + 1
            snaps[frame.f_lineno] = {k: short(v) for k, v in frame.f_locals.items()}
        return trace
    out = {"status": "ok", "result": None, "exc": None}
    signal.setitimer(signal.ITIMER_REAL, cfg["call_s"])
    try:
        exec(compile(code, "<fn>", "exec"), space)
        args = [eval(a, {"__builtins__": {"set": set}}) for a in call["args"]]
        kwargs = {k: eval(a, {"__builtins__": {"set": set}}) for k, a in call["kwargs"].items()}
        sys.settrace(trace)
        try: value = space[name](*args, **kwargs)
        finally: sys.settrace(None)
        out["result"] = short(value)
    except Late: out["status"] = "timeout"
    except Exception as e: out.update(status="raised", exc=type(e).__name__)
    except BaseException as e: out.update(status="fatal", exc=type(e).__name__)
    finally: signal.setitimer(signal.ITIMER_REAL, 0)
    out["lines"] = {str(k): v for k, v in counts.items()}
    out["snaps"] = {str(k): v for k, v in snaps.items()}
    return out
print(json.dumps([[[one(t["code"], t["name"], c) for c in t["calls"]] for t in cfg["tasks"]] for _ in range(2)]))
'''


def run(tasks: list[dict]) -> list[list[dict] | None]:
    """Outcomes of each task's calls; null where the child died on it."""
    if not tasks:
        return []
    config = {"cpu": CPU_S, "memory": MEMORY_MB, "call_s": CALL_S, "events": EVENTS, "banned": sorted(BANNED), "modules": MODULES, "tasks": tasks}
    try:
        done = subprocess.run([sys.executable, "-I", "-c", _CHILD], input=json.dumps(config), capture_output=True, text=True, timeout=BATCH_S, env={"PYTHONHASHSEED": "0"})
        once, again = json.loads(done.stdout)
    except (subprocess.TimeoutExpired, ValueError):
        if len(tasks) == 1:
            return [None]
        middle = len(tasks) // 2
        return run(tasks[:middle]) + run(tasks[middle:])
    return [[x if x == y else {**x, "status": "nondet"} for x, y in zip(a, b)] for a, b in zip(once, again)]


def facts_of(codes: list[str | None]) -> list[list[tuple]]:
    """(status, reason, intent, seed, answer) rows of each code; one row without intent where there is no fact."""
    tasks, places, out = [], [], []
    for i, code in enumerate(codes):
        node, reason = screen(code or "")
        out.append([("screened", reason, None, None, None)] if node is None else [])
        if node is not None:
            tasks.append({"code": repaired(code)[0], "name": node.name, "calls": inputs(node)})
            places.append((i, node))
    results: list[list[dict] | None] = []
    for at in range(0, len(tasks), 32):
        results += run(tasks[at : at + 32])
    for (i, node), task, outcome in zip(places, tasks, results):
        if outcome is None:
            out[i] = [("died", None, None, None, None)]
            continue
        rows = [("ok", None, intent, json.dumps(seed, sort_keys=True), answer) for intent, seed, answer in _facts(node, task, outcome)]
        out[i] = rows or [("ok", None, None, None, None)]
    return out


def _facts(node: ast.FunctionDef, task: dict, outcome: list[dict]) -> list[tuple[str, dict, str]]:
    calls = [{"args": c["args"], "kwargs": c["kwargs"]} for c in task["calls"]]
    good = [i for i, (c, o) in enumerate(zip(task["calls"], outcome)) if o["status"] == "ok" and o["result"] is not None and c["empty"] is None]
    out: list[tuple[str, dict, str]] = [("D1", calls[i], outcome[i]["result"]) for i in good]
    results = [outcome[i]["result"] for i in good]
    out += [("D2", {"output": outcome[i]["result"]}, ", ".join(calls[i]["args"])) for i in good if results.count(outcome[i]["result"]) == 1 and len(good) > 1]
    body = node.body[1:] if docstring_of(node) is not None else node.body
    branch = next((n for n in ast.walk(node) if isinstance(n, ast.If)), None)
    loop = next((n for n in ast.walk(node) if isinstance(n, (ast.For, ast.While))), None)
    for i in good:
        lines, snaps = outcome[i]["lines"], outcome[i]["snaps"]
        for n in body:
            if isinstance(n, ast.Assign) and isinstance(n.targets[0], ast.Name):
                later = sorted(int(k) for k in snaps if int(k) > n.end_lineno)
                value = snaps[str(later[0])].get(n.targets[0].id) if later else None
                if value is not None:
                    out.append(("D3", {**calls[i], "var": n.targets[0].id, "line": n.lineno}, value))
                break
        last = body[-1].lineno
        out.append(("D4", {**calls[i], "line": last}, "yes" if str(last) in lines else "no"))
        if branch is not None:
            out.append(("D5", {**calls[i], "line": branch.lineno}, "yes" if str(branch.body[0].lineno) in lines else "no"))
        if loop is not None:
            out.append(("D6", {**calls[i], "line": loop.lineno}, str(lines.get(str(loop.body[0].lineno), 0))))
    for c, o, call in zip(task["calls"], outcome, calls):
        if c["empty"] is None and o["status"] == "raised" and c["typed"]:
            out.append(("D7", call, o["exc"]))
        if c["empty"] is not None and o["status"] in ("ok", "raised"):
            what = f"raises {o['exc']}" if o["status"] == "raised" else o["result"]
            if what is not None:
                out.append(("C2x", {**call, "param": c["empty"]}, what))
    return out
