"""Figures as SVG text. The data of a figure is what the caller lists: a grid of listed ids, or links among them."""

from __future__ import annotations

from html import escape
from textwrap import wrap

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL_W, CELL_H, MARGIN = 110, 56, 220


def _text(x: float, y: float, value: str, **style: str) -> str:
    attributes = "".join(f' {k.replace("_", "-")}="{v}"' for k, v in style.items())
    return f'<text x="{x:.1f}" y="{y:.1f}"{attributes}>{escape(value)}</text>'


def _page(width: float, height: float, body: list[str]) -> str:
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:.0f}" height="{height:.0f}" font-family="sans-serif">'
    return "\n".join([head, '<rect width="100%" height="100%" fill="white"/>', *body, "</svg>"])


def pair_grid_svg(styled: DataFrame) -> str:
    """The combined heatmap: fill and centre number by the first signal, borders by agreement.

    ``styled`` is ``cell_style`` output with ``label_a, label_b``.
    """
    cells = styled.collect()
    columns = sorted({c.label_a for c in cells}, key=str.casefold)
    lines = sorted({c.label_b for c in cells}, key=str.casefold)
    grey = {"grey80": "#CCCCCC", "grey45": "#737373"}
    body = []
    for c in cells:
        x, y = MARGIN + columns.index(c.label_a) * CELL_W, lines.index(c.label_b) * CELL_H + 20
        body.append(f'<rect x="{x}" y="{y}" width="{CELL_W}" height="{CELL_H}" fill="{c.fill}"/>')
        if c.border != "none":
            dash = ' stroke-dasharray="5 3"' if c.border == "dashed" else ""
            body.append(
                f'<rect x="{x + 4}" y="{y + 2}" width="{CELL_W - 8}" height="{CELL_H - 4}" fill="none" stroke="black"{dash}/>'
            )
        first = {"fill": grey.get(c.color_stage1, c.color_stage1), "font_weight": c.face_stage1.replace("plain", "normal")}
        second = {"fill": grey.get(c.color_stage2, c.color_stage2), "font_weight": c.face_stage2.replace("plain", "normal")}
        middle = {"text_anchor": "middle"}
        body.append(_text(x + CELL_W / 2, y + 24, c.text_percentile, font_size="15", **middle, **first))
        body.append(_text(x + CELL_W * 0.25, y + CELL_H - 8, c.text_sim, font_size="11", **middle, **first))
        body.append(_text(x + CELL_W * 0.75, y + CELL_H - 8, c.text_jaccard, font_size="11", **middle, **second))
    for i, label in enumerate(lines):
        body.append(_text(MARGIN - 8, i * CELL_H + 20 + CELL_H / 2, label, text_anchor="end", font_size="12"))
    foot = len(lines) * CELL_H + 36
    for i, label in enumerate(columns):
        for k, part in enumerate(wrap(label, 12)):
            body.append(_text(MARGIN + (i + 0.5) * CELL_W, foot + 14 * k, part, text_anchor="middle", font_size="12"))
    return _page(MARGIN + len(columns) * CELL_W + 20, foot + 60, body)


def link_curves_svg(points: DataFrame, nodes: DataFrame, value: str, title: str, ids: list[str]) -> str:
    """Links among the listed definitions as curves between two columns of nodes.

    ``points`` has ``id_a, id_b, point, x, y`` and the value; ``nodes`` has ``id, x, y, label``.
    """
    listed = F.col("id_a").isin(ids) & F.col("id_b").isin(ids)
    rows = points.filter(listed).orderBy("id_a", "id_b", "point").collect()
    marks = nodes.filter(F.col("id").isin(ids)).collect()
    width, height = 760.0, max(360.0, 14.0 * len(marks))
    place = lambda x, y: (220 + x * (width - 440), 40 + (1 - y) * (height - 60))
    paths: dict[tuple, list] = {}
    for r in rows:
        paths.setdefault((r.id_a, r.id_b, r[value]), []).append(place(r.x, r.y))
    high = max((k[2] for k in paths), default=1.0) or 1.0
    body = [_text(width / 2, 20, title, text_anchor="middle", font_size="13")]
    for (_, _, v), curve in paths.items():
        line = " ".join(f"{x:.1f},{y:.1f}" for x, y in curve)
        body.append(f'<polyline points="{line}" fill="none" stroke="#737373" opacity="0.4" stroke-width="{0.3 + 4 * v / high:.2f}"/>')
    for n in marks:
        x, y = place(n.x, n.y)
        left = n.x < 0.5
        body.append(f'<line x1="{x:.1f}" y1="{y - 4:.1f}" x2="{x:.1f}" y2="{y + 4:.1f}" stroke="{"#2563eb" if left else "#16a34a"}" stroke-width="5"/>')
        body.append(_text(x + (-8 if left else 8), y + 4, n.label[:30], text_anchor="end" if left else "start", font_size="10"))
    return _page(width, height, body)


def matrix_svg(matrix: DataFrame, title: str) -> str:
    """Keyset x keyset means as a labelled grid; one cell for each pair of keysets."""
    cells = matrix.collect()
    names = sorted({c.keyset_a for c in cells} | {c.keyset_b for c in cells})
    high = max((c.mean_value for c in cells), default=1.0) or 1.0
    body = [_text(MARGIN, 14, title, font_size="13")]
    for c in cells:
        x, y = MARGIN + names.index(c.keyset_a) * CELL_W, 24 + names.index(c.keyset_b) * CELL_H
        shade = round(255 - 155 * max(c.mean_value, 0) / high)
        body.append(f'<rect x="{x}" y="{y}" width="{CELL_W}" height="{CELL_H}" fill="rgb({shade},{shade},255)"/>')
        body.append(_text(x + CELL_W / 2, y + CELL_H / 2, f"{c.mean_value:.3f}", text_anchor="middle", font_size="12"))
    for i, name in enumerate(names):
        body.append(_text(MARGIN - 8, 24 + (i + 0.5) * CELL_H, name, text_anchor="end", font_size="11"))
        body.append(_text(MARGIN + (i + 0.5) * CELL_W, 44 + len(names) * CELL_H, name, text_anchor="middle", font_size="11"))
    return _page(MARGIN + len(names) * CELL_W + 20, 60 + len(names) * CELL_H, body)
