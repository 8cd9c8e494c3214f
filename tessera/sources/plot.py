"""Line charts of reports, where matplotlib is installed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence


def plot_reports(series: Mapping[str, Sequence[tuple[float, float]]], path: str, x: str, y: str, title: str = "") -> None:
    """One line for each named report of (x, y) rows, as PNG."""
    try:
        import matplotlib
    except ImportError as e:
        raise RuntimeError("plots need matplotlib") from e
    matplotlib.use("Agg")
    from matplotlib import pyplot as plt

    fig, ax = plt.subplots()
    for name, rows in series.items():
        ax.plot([r[0] for r in rows], [r[1] for r in rows], marker="o", label=name)
    ax.set_xlabel(x), ax.set_ylabel(y), ax.set_title(title)
    ax.legend()
    fig.savefig(path)
    plt.close(fig)


def als_label(name: str) -> str:
    """``rank_lambda`` as a legend entry."""
    return f"lambda = {name.rsplit('.', 1)[0].partition('_')[2] if name.endswith('.txt') else name.partition('_')[2]}"
