"""A solver file: the centre of a cell's points, weighted by their third number."""


def solve(cell):
    points = [p for p in cell["points"] if p[2] > 0]
    if not points:
        raise ValueError("no weight")
    total = sum(w for _, _, w in points)
    return {"x": sum(x * w for x, _, w in points) / total, "y": sum(y * w for _, y, w in points) / total}
