"""Export files used by the tests (written to a temp folder per test): two
invented exports of two ads each, with the traits real ones have - names that
are not ASCII, `-` rankings, `Ongoing`, a blank measure, a text budget."""

import csv
import io
import os

from adlens.schema import REQUIRED_COLUMNS, SNAKE

# --- Fixed values: the invented ads ---------------------------------------------
NAME_A, NAME_B = "spring sale.csv", "herbst_2024.csv"
STARTS, ENDS = "2024-03-01", "2024-09-30"
_MEASURES = ("results", "reach", "spend", "impressions", "link_clicks", "clicks_all", "cost_per_result")
A1 = dict(ad_name="Éclair léger", ad_delivery="active", **dict(zip(_MEASURES, (120, 5000, 300.50, 20000, 150, 210, 2.50416667))))
A2 = dict(ad_name="Éclair léger, 2e", ad_delivery="active", **dict(zip(_MEASURES, (30, 2500, 99.25, 6000, 40, 66, 3.30833333))))
B1 = dict(ad_name="Größenwahn", ad_delivery="active", **dict(zip(_MEASURES, (800, 9000, 240.0, 64000, 900, 950, 0.3))))
B2 = dict(ad_name="Größenwahn zwei", ad_delivery="inactive", **dict(zip(_MEASURES, (10, 700, 12.75, 1500, 12, 20, 1.275))))
# --- end of fixed values ----------------------------------------------------------
ADS_A, ADS_B = [A1, A2], [B1, B2]
ADS = ADS_A + ADS_B


def total(name: str, ads=ADS) -> float:
    return sum(a[name] for a in ads)


def cells(ad: dict) -> list[str]:
    """The ad as a row of export text, in the order of the required columns."""
    text = {"reporting_starts": STARTS, "reporting_ends": ENDS, "attribution_setting": "7-day click", "ends": "Ongoing",
            "result_indicator": "clicks", "ad_set_budget": "By campaign", "ad_set_budget_type": "0",
            "quality_ranking": "-", "engagement_ranking": "-", "conversion_ranking": "-", "shop_clicks": "",
            "frequency": ad["impressions"] / ad["reach"], "cpm": ad["spend"] / ad["impressions"] * 1000,
            "cpc_link": round(ad["spend"] / ad["link_clicks"], 6), "cpc_all": round(ad["spend"] / ad["clicks_all"], 6),
            "ctr_link": ad["link_clicks"] / ad["impressions"] * 100, "ctr_all": ad["clicks_all"] / ad["impressions"] * 100}
    text |= ad
    return [str(text[SNAKE[h]]) for h in REQUIRED_COLUMNS]


def _line(values) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(values)
    return out.getvalue()


HEADER = _line(REQUIRED_COLUMNS)
SAMPLE_A, SAMPLE_B = ([_line(cells(a)) for a in ads] for ads in (ADS_A, ADS_B))


def write(folder, name, lines, encoding="utf-8", raw: bytes | None = None):
    os.makedirs(folder, exist_ok=True)
    p = os.path.join(folder, name)
    with open(p, "wb") as f:
        f.write(raw if raw is not None else ("\n".join(lines) + "\n").encode(encoding))
    return p


def write_samples(folder):
    return [write(folder, NAME_A, [HEADER] + SAMPLE_A), write(folder, NAME_B, [HEADER] + SAMPLE_B)]
