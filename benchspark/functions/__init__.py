"""Column libraries: text, labels, stored responses, geometry, prompts."""
