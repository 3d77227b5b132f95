"""What the test modules share besides fixtures."""

from datetime import datetime, timezone

SMALL = "/root/testdata/sf0.001"


def utc(text: str) -> datetime:
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


def tuples(df):
    return [tuple(row) for row in df.collect()]


def scans(df):
    """The file scans of a DataFrame after running it: files and rows read, folders, filters, and
    what is above each in the plan as it ran, from the scan upwards."""
    df.collect()
    found = []

    def walk(node, above=()):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan(), above)
        if kind.endswith("QueryStageExec"):
            return walk(node.plan(), above)
        if kind == "FileSourceScanExec":
            metrics = node.metrics()
            found.append({
                "files": metrics.apply("numFiles").value(), "rows": metrics.apply("numOutputRows").value(),
                "paths": node.relation().location().rootPaths().mkString(","), "text": node.toString(), "above": above,
            })
        children = node.children()
        for k in range(children.length()):
            walk(children.apply(k), (kind, *above))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def final_plan(df):
    """The plan as it ran, after adaptive changes."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
