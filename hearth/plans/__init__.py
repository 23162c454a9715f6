"""Plan-shaping helpers: how a job is joined, fanned out, merged and cut, not what it computes."""
