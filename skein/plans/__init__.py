"""Plan building blocks: shared storage, fixpoint loops, components, ranking."""
