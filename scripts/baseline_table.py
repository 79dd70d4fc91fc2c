
import json
import sys

sys.path.insert(0, __file__.rsplit("/", 2)[0])

from tokenloom.plans import QUERIES  # noqa: E402


def main(path: str) -> None:
    d = json.loads(open(path).read().strip().splitlines()[-1])
    cfg = f"Spark {d['spark']}, local[{d['cpus']}], driver 16g, sf{d['sf']}"
    print("| query | operators | sec (median of 3) | rows out | config |")
    print("|---|---|---|---|---|")
    for name in sorted(d["queries"]):
        doc = (QUERIES[name].__doc__ or "").strip().splitlines()[0]
        ops = doc.split(":")[0] if ":" in doc else doc
        print(f"| `{name}` | {ops} | {d['queries'][name]:.2f} | {d['rows'].get(name, '')} | {cfg} |")
    print(f"| **total** | {len(d['queries'])} queries | {d['value']:.2f} | | {cfg} |")


if __name__ == "__main__":
    main(sys.argv[1])
