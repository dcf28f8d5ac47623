"""HTML pages around figures and tables that were computed before."""

from __future__ import annotations

import os
from html import escape

STYLE = "body{font-family:sans-serif;max-width:60rem;margin:2rem auto}figure{margin:2rem 0}"


def _page(title: str, body: list[str]) -> str:
    return "\n".join(
        [
            '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8">',
            f"<title>{escape(title)}</title><style>{STYLE}</style></head><body>",
            f"<h1>{escape(title)}</h1>",
            *body,
            "</body></html>",
        ]
    )


def save_figure(svg: str, folder: str, name: str) -> str:
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{name}.svg")
    with open(path, "w", encoding="utf-8") as f:
        f.write(svg)
    return path


def download_line(folder: str, name: str) -> str:
    """Links to the formats a figure was saved in."""
    kinds = [k for k in ("svg", "png", "pdf", "eps") if os.path.exists(os.path.join(folder, f"{name}.{k}"))]
    links = " · ".join(f'<a href="{escape(folder)}/{escape(name)}.{k}">{k.upper()}</a>' for k in kinds)
    return f"<p><b>Download:</b> {links}</p>"


def report_page(title: str, figures: list[tuple[str, str]]) -> str:
    """A report with each figure (caption, SVG text) in place."""
    return _page(title, [f"<figure>{svg}<figcaption>{escape(caption)}</figcaption></figure>" for caption, svg in figures])


def index_page(title: str, reports: list[tuple[str, str, str]]) -> str:
    """A list of reports: file, name, description."""
    items = [
        f'<li><a href="{escape(file)}">{escape(name)}</a>: {escape(text)}</li>' for file, name, text in reports
    ]
    return _page(title, ["<ul>", *items, "</ul>"])
