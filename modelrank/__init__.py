"""Search a pool of models for transfer learning, as Spark plans."""
