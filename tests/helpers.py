"""Comparison of result frames."""


def rows_of(frame) -> list:
    """Rows as sorted text, columns by name; floats to nine places, missing as None."""
    import math

    def show(v):
        if v is None or v is getattr(__import__("pandas"), "NA", None) or isinstance(v, float) and math.isnan(v):
            return "None"
        if isinstance(v, float):
            return repr(round(v, 9)) if not v.is_integer() else str(int(v))
        return str(v)

    frame = frame[sorted(frame.columns)]
    return sorted("|".join(map(show, r)) for r in frame.astype(object).itertuples(index=False))
