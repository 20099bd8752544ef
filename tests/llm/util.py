"""Small brute-force helpers of these tests."""


def least_reachable(nodes, linked):
    """Smallest node reachable from each node; linked(a, b) says whether two are linked."""
    nodes = list(nodes)
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if root[a] > root[b] and linked(a, b):
                    root[a], changed = root[b], True
    return root


def python_nodes(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [w for w in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoop") if w in plan]
