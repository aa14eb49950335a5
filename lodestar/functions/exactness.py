"""Numbers as text."""


def text_number(v: float) -> str:
    """Whole numbers plainly, others to twelve digits."""
    return str(int(round(v))) if abs(v - round(v)) < 1e-9 * max(1.0, abs(v)) and abs(v) < 1e15 else f"{v:.12g}"
