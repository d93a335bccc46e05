"""Plan building blocks: lineage cuts and iterative graph plans."""
