"""lithic: decision-support operators and queries declared with the DataFrame API."""
