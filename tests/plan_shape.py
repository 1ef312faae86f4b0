"""Reading the physical plan tree of a DataFrame (test helper)."""
import re


def formatted(df):
    """The text ``df.explain('formatted')`` prints."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def plan_tree(df):
    """(name, depth, parent_index) per node of the physical plan, from the tree
    part of ``explain('formatted')`` (AQE's initial plan)."""
    text = formatted(df)
    tree = text.split("\n\n")[0].splitlines()[1:]
    nodes, stack = [], []
    for line in tree:
        m = re.search(r"[A-Za-z]", line)
        if not m:
            continue
        depth = m.start()
        name = re.sub(r"\s*\(\d+\)\s*$", "", line[depth:]).strip()
        while stack and nodes[stack[-1]][1] >= depth:
            stack.pop()
        nodes.append((name, depth, stack[-1] if stack else None))
        stack.append(len(nodes) - 1)
    return nodes


def ancestors(nodes, i):
    out = []
    p = nodes[i][2]
    while p is not None:
        out.append(p)
        p = nodes[p][2]
    return out


def joins_above_raw_scans(nodes):
    """Joins that have a table scan below them with no aggregate in between."""
    bad = []
    for i, (name, _, _) in enumerate(nodes):
        if not name.startswith("Scan"):
            continue
        path = ancestors(nodes, i)
        for a in path:
            an = nodes[a][0]
            if an.startswith("HashAggregate") or an.startswith("ObjectHashAggregate"):
                break
            if "Join" in an:
                bad.append(an)
                break
    return bad


def _children(node):
    kids = [node.children().apply(i) for i in range(node.children().size())]
    for attr in ("plan", "executedPlan"):  # query stages / adaptive wrapper
        try:
            inner = getattr(node, attr)()
            if hasattr(inner, "children"):
                kids.append(inner)
        except Exception:  # noqa: BLE001
            pass
    return kids


def shuffle_records_written(df) -> list[int]:
    """After an action: records written by each shuffle exchange of the executed plan."""
    out, seen, todo = [], set(), [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        key = node.hashCode()
        if key in seen:
            continue
        seen.add(key)
        if node.nodeName().startswith("Exchange") and not node.nodeName().startswith("BroadcastExchange"):
            m = node.metrics()
            if m.contains("shuffleRecordsWritten"):
                out.append(int(m.apply("shuffleRecordsWritten").value()))
        todo.extend(_children(node))
    return out
